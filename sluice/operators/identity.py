"""Content keys, deduplication and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.canonical import canonical, canonical_columns
from sluice.session import kept


def content_key(*fields: DataFrame | str | Column, **named: Column) -> Column:
    """SHA-256 over the canonical JSON of fields: columns by their names, expressions by keyword (or by place, as f0, f1, ..).

    The first argument is the frame whose columns they are: its types decide how values are written. Without one all
    values count as strings."""
    df = fields[0] if fields and isinstance(fields[0], DataFrame) else None
    fields = fields[1:] if df is not None else fields
    placed = {f"f{i}": f for i, f in enumerate(fields) if not isinstance(f, str)} | named
    names = [f for f in fields if isinstance(f, str)]
    if df is not None:
        return F.sha2(canonical_columns(df, *names, **placed), 256)
    values = {f: F.col(f) for f in names} | placed
    return F.sha2(canonical(F.struct(*[v.cast("string").alias(k) for k, v in values.items()]), T.StructType([T.StructField(k, T.StringType()) for k in values])), 256)


def external_key(dataset: Column, record: Column) -> Column:
    return F.sha2(F.concat(dataset, F.char(F.lit(0)), record), 256)


def dedup(df: DataFrame, key: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key: the first by ``order`` (the last with ``last``). The aggregate is partial
    before its shuffle, so a key that holds a third of the rows meets as one row per task."""
    position = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = (F.max_by if last else F.min_by)(row, position)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(pick.alias("_row")).select("_row.*")


def collisions(df: DataFrame, key: list[str], plan: Column) -> DataFrame:
    """Keys that name different plans: rows and distinct plans of each."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(plan).alias("n_plans")).where("n_plans > 1")


def assert_no_collision(df: DataFrame, key: list[str], plan: str) -> DataFrame:
    """``df`` as it is; it fails when read if a key names two plans."""
    many = df.groupBy(*key).agg(F.min(plan).alias("_a"), F.max(plan).alias("_b"))
    checked = many.withColumn("_ok", F.assert_true(F.col("_a") == F.col("_b"), F.lit("one key names different plans")).isNull()).select(*key, "_ok")
    return df.join(checked, key).where("_ok").drop("_ok")


def with_row_index(df: DataFrame, order: list[str], column: str = "row_index") -> DataFrame:
    """A 0-based position by ``order`` without one task for all rows: rows are ranged, counted
    per range, and each range's offset (one number per partition) is joined back.

    The ranged rows are kept in the shared folder: both uses see the same ranges, and a lost executor costs only
    its running tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start"))  # a row per partition
    return ranged.join(F.broadcast(starts), "_pid").withColumn(column, F.col("_start") + F.col("_at")).drop("_pid", "_at", "_start")
