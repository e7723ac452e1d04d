"""A manifest's row index: byte offsets of its lines, point and range reads, and checks over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.identity import with_row_index
from sluice.operators.ranges import folded


def line_index(manifest: DataFrame, order: list[str], line: Column) -> DataFrame:
    """``manifest`` with row_index, and with the byte offset at which each row's line starts when the lines are
    written one after another, each with a newline.

    Sums run within blocks of rows; the blocks' own offsets (a row per 65,536 rows) are added."""
    rows = with_row_index(manifest.withColumn("_bytes", F.octet_length(line) + 1), order).withColumn("_block", F.floor(F.col("row_index") / 65_536))
    inside = Window.partitionBy("_block").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy("_block").agg(F.sum("_bytes").alias("_sum"))
    starts = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_start"))
    met = rows.withColumn("_at", F.sum("_bytes").over(inside) - F.col("_bytes")).join(starts, "_block")
    return met.withColumn("offset", F.col("_start") + F.col("_at")).drop("_bytes", "_block", "_at", "_start")


def source_ranges(sources: DataFrame, by: list[str], order: str, rows: str) -> DataFrame:
    """Rows that concatenated sources take in their task: start and end (exclusive). One row per source."""
    end = F.sum(rows).over(Window.partitionBy(*by).orderBy(order))
    return sources.withColumn("end", end).withColumn("start", F.col("end") - F.col(rows))


def overlap_of_range(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """The part of [low, high) that lies in each source, in the source's own row numbers."""
    some = ranges.where((F.col("start") < high) & (F.col("end") > low))
    return some.withColumn("local_start", F.greatest(F.lit(low), "start") - F.col("start")).withColumn("local_end", F.least(F.lit(high), "end") - F.col("start"))


def index_mismatches(manifest: DataFrame, index: DataFrame, fields: list[str]) -> DataFrame:
    """row_index and problem of every row in which an index and its manifest differ: a row that one side lacks,
    else the first field that differs."""
    left = manifest.select("row_index", F.lit(True).alias("_m"), *[F.col(c).alias(f"_m_{c}") for c in fields])
    right = index.select("row_index", F.lit(True).alias("_i"), *[F.col(c).alias(f"_i_{c}") for c in fields])
    problem = F.when(F.col("_m").isNull(), "not_in_manifest").when(F.col("_i").isNull(), "not_in_index")
    for c in fields:
        problem = problem.when(~F.col(f"_m_{c}").eqNullSafe(F.col(f"_i_{c}")), c)
    return left.join(right, "row_index", "full").select("row_index", problem.alias("problem")).where("problem is not null")


def marker_problem(marker: dict[str, Column], expected: dict[str, Column]) -> Column:
    """The first field of a shard's marker that is not as expected; null if the shard may be reused."""
    out = None
    for name, want in expected.items():
        differs = ~marker[name].eqNullSafe(want)
        out = F.when(differs, F.lit(name)) if out is None else out.when(differs, F.lit(name))
    return out


def merge_problems(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """What is wrong with shards before a merge: rows outside the shard's range or out of order, and counts that
    don't equal the marker's. rows: shard, position (in its file), row_index; shards: shard, start, end, n_rows."""
    def columns(w):
        return {"_before": F.lag("row_index").over(w), "_at": F.row_number().over(w)}

    summary = {"n": F.count(F.lit(1)), "outside": F.count_if((F.col("row_index") < F.col("start")) | (F.col("row_index") >= F.col("end"))), "disordered": F.count_if(F.col("row_index") <= F.col("_before")), "first": F.min_by("row_index", "_at"), "last": F.max_by("row_index", "_at")}
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("outside"), zero.alias("disordered"), F.lit(None).cast("long").alias("last"))

    def combine(acc, part):
        falls = F.coalesce((part["first"] <= acc["last"]).cast("long"), zero)
        return F.struct((acc["n"] + part["n"]).alias("n"), (acc["outside"] + part["outside"]).alias("outside"), (acc["disordered"] + part["disordered"] + falls).alias("disordered"), part["last"].alias("last"))

    met = rows.join(F.broadcast(shards), "shard")  # a row per shard
    got = folded(met, ["shard", "n_rows"], ["position"], columns, summary, start, combine, "r")
    return got.select("shard", F.col("r.outside").alias("outside"), F.col("r.disordered").alias("disordered"), (F.col("r.n") - F.col("n_rows")).alias("surplus"))
