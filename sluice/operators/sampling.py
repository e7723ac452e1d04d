"""Deterministic sampling: hashed orders, strides, schedules and quotas."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.identity import with_row_index


def hash_order(seed: str, *keys: str) -> Column:
    """A pseudo-random but fixed sort key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def unit(seed: str, *keys: str) -> Column:
    """A fixed draw in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw_category(draw: Column, shares: list[tuple[str, float]]) -> Column:
    """The first category whose cumulative share exceeds the draw; the last one beyond."""
    out, total = None, 0.0
    for name, share in shares[:-1]:
        total += share
        hit = draw < total
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(shares[-1][0])) if out is not None else F.lit(shares[-1][0])


def stride_walk(n: int, seed: str) -> tuple[int, int]:
    """(start, stride) of a walk through 0..n-1: the stride is coprime to n."""
    if n <= 1:
        return 0, 1
    h = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big")
    stride = h // n % (n - 1) + 1
    while math.gcd(stride, n) != 1:
        stride = stride % (n - 1) + 1
    return h % n, stride


def walk_position(row_index: Column, n: int, seed: str) -> Column:
    """The place of a row in the walk: the inverse of start + pos * stride mod n."""
    return place_in_walk(row_index, n, *stride_walk(n, seed))


def place_in_walk(row_index: Column, n: int, start: int, stride: int) -> Column:
    inverse = pow(stride, -1, n) if n > 1 else 0
    return F.pmod((row_index - start) * inverse, F.lit(max(n, 1)))


def first_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits ranks before its shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def stratified(df: DataFrame, by: list[str], stratum: str, position: str, k: int, strata: int = 4) -> DataFrame:
    """k rows of each group: first the earliest of each stratum 1..strata (ascending), then others
    by position. Only rows up to the stop count: the first position at which min(k, strata)
    strata and k rows have been seen. No window but the ranks' (which Spark limits before its shuffle)
    holds more than k + 2 strata rows of a group."""
    rows = df.where(F.col(stratum).between(1, strata))
    #: all that can matter: the first k rows, some more to fill up with, and the first of each stratum
    few = first_k(rows, by, [position], k + strata).unionByName(first_k(rows, [*by, stratum], [position], 1)).dropDuplicates([*by, position])
    group = Window.partitionBy(*by)
    few = few.withColumn("_seen", F.row_number().over(group.orderBy(position))).withColumn("_first", F.row_number().over(Window.partitionBy(*by, stratum).orderBy(position)) == 1)
    firsts = F.sort_array(F.collect_list(F.when(F.col("_first"), F.col(position))).over(group))  # one of each stratum
    kth = F.max(F.when(F.col("_seen") == k, F.col(position))).over(group)
    few = few.withColumn("_kinds", F.get(firsts, min(k, strata) - 1)).withColumn("_kth", kth)
    stop = F.when(F.col("_kinds").isNotNull() & F.col("_kth").isNotNull(), F.greatest("_kinds", "_kth"))
    near = few.where(stop.isNull() | (F.col(position) <= stop))
    rank = group.orderBy(F.when(F.col("_first"), F.col(stratum)).otherwise(F.lit(strata + 1)), position)
    return near.withColumn("pick", F.row_number().over(rank)).where(F.col("pick") <= k).drop("_seen", "_kinds", "_kth", "_first")


def apportion(shares: DataFrame, share: str, name: str, total: int) -> DataFrame:
    """Largest-remainder quotas of ``total`` by ``share``; ties by name. One row per source."""
    every = Window.partitionBy()
    exact = F.col(share) * total / F.sum(share).over(every)
    floors = shares.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(every)
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), name))
    return floors.withColumn("quota", F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).drop("_exact", "_floor")


def exact_share(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """``df`` with ``chosen``: true for the first round(share * rows) rows by ``order`` (halves to even). Places come from ranges
    and counts per range."""
    placed = with_row_index(df, order, "_place")
    n = placed.count()
    return placed.withColumn("chosen", F.col("_place") < round(n * share)).drop("_place")
