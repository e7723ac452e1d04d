"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins on the edges; nothing is collected but
two numbers a round. A hub's edges are never gathered in one row: its smallest
neighbour comes from a partially aggregated minimum and is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.store import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    if large:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    both = around.join(least, "u")
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) of every vertex that is not the smallest of its component."""
    now = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:  # logarithmic in the largest component
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = keep(_star(_star(now, True), False), "edges")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
