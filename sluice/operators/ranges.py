"""Ordered work on keys of any size: rows are dealt over ranges of key and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sluice.session import kept


def equal_runs(df: DataFrame, on: str, order: str, value: str) -> DataFrame:
    """(on, value, first, last, n) of each maximal run of rows with an equal ``value`` in the order of a key's rows.

    Rows are ranged by key and order and kept, so a key with a third of all rows is dealt over many tasks. Runs are
    found in each range; only the first run of a range's least key and the last run of its greatest key can go on in a
    neighbouring range, so two rows a range are put together at most. Nulls equal each other, as keys and as values;
    an empty table has no runs."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(on).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    ranged = kept(rows.repartitionByRange(n, "k", "o").withColumn("range", F.spark_partition_id()), "runs")
    along = Window.partitionBy("range", "k").orderBy("o")
    turn = (F.row_number().over(along) == 1) | ~F.lag("v").over(along).eqNullSafe(F.col("v"))
    local = ranged.withColumn("turn", turn.cast("int")).withColumn("run", F.sum("turn").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = local.groupBy("range", "k", "run").agg(F.first("v").alias("v"), F.min("o").alias("first"), F.max("o").alias("last"), F.count(F.lit(1)).alias("n"))
    ends = ranged.groupBy("range").agg(F.min(F.struct("k")).alias("least"), F.max(F.struct("k")).alias("greatest"))
    met = runs.withColumn("runs", F.max("run").over(Window.partitionBy("range", "k"))).join(F.broadcast(ends), "range")  # a row per range
    key = F.struct("k")
    met = met.withColumn("open", (key.eqNullSafe(F.col("least")) & (F.col("run") == 1)) | (key.eqNullSafe(F.col("greatest")) & (F.col("run") == F.col("runs"))))
    met = kept(met.select("range", "k", "run", "v", "first", "last", "n", "open"), "local_runs")
    beside = Window.partitionBy("k").orderBy("range", "run")
    goes_on = (F.lag("range").over(beside) < F.col("range")) & F.lag("v").over(beside).eqNullSafe(F.col("v"))
    edges = met.where("open").withColumn("turn", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("turn").over(beside))
    joined = edges.groupBy("k", "run").agg(F.first("v").alias("v"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    out = met.where("not open").select("k", "v", "first", "last", "n").unionByName(joined.drop("run"))
    return out.select(F.col("k").alias(on), F.col("v").alias(value), "first", "last", "n")


def _ranged(df: DataFrame, on: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` dealt over ranges of key and order, and kept; ``_range`` is a row's range. A key is in neighbouring ranges only."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *on, *order).withColumn("_range", F.spark_partition_id()), name)


def numbered(df: DataFrame, on: list[str], order: list[str], column: str) -> DataFrame:
    """``df`` with each row's place (from 0) among its key's rows, for keys of any size.

    Rows are numbered within a range. Only a range's least key can have begun before it, so what is added is a row per
    range at most. Nulls are a key like any other; ties in ``order`` are numbered as they come."""
    ranged = _ranged(df, on, order, "numbered")
    key = F.struct(*on)
    counts = ranged.groupBy("_range", *on).agg(F.count(F.lit(1)).alias("_n"))
    ends = F.broadcast(ranged.groupBy("_range").agg(F.min(key).alias("_least"), F.max(key).alias("_greatest")))  # a row per range
    open_ = counts.join(ends, "_range").where(key.eqNullSafe(F.col("_least")) | key.eqNullSafe(F.col("_greatest")))
    before = F.sum("_n").over(Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = open_.select(F.col("_range").alias("_into"), *[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], before.alias("_before")).where("_before is not null")
    same = F.col("_range") == F.col("_into")
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    along = Window.partitionBy("_range", *on).orderBy(*order)
    local = ranged.withColumn(column, (F.row_number().over(along) - 1).cast("long"))
    return local.join(F.broadcast(carried), same, "left").withColumn(column, F.col(column) + F.coalesce("_before", F.lit(0))).select(*df.columns, column)  # a row per range at most


def folded(df: DataFrame, on: list[str], order: list[str], columns: Callable[[WindowSpec], dict[str, Column]], summary: dict[str, Column], start: Column, combine: Callable[[Column, Column], Column], column: str) -> DataFrame:
    """One result per key of an associative fold over its rows in order, for keys of any size.

    Within a range, ``columns`` (over a window of the key's rows) and ``summary`` (aggregates of them) make one row of
    each key; the ranges' rows of a key, in order, are then combined from ``start`` on. So a task holds a range, and the last step as many rows of
    a key as there are ranges."""
    ranged = _ranged(df, on, order, "folded")
    along = Window.partitionBy("_range", *on).orderBy(*order)
    parts = ranged.withColumns(columns(along)).groupBy("_range", *on).agg(*[v.alias(k) for k, v in summary.items()])
    listed = parts.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_range", *summary))).alias("_parts"))
    return listed.select(*on, F.aggregate("_parts", start, combine).alias(column))
