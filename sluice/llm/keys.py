"""Joins of wide rows with key lists, without shuffling rows that cannot match.

A bitmap of ``WORDS`` x 64 bits is or-ed over the keys and joined as a broadcast of at most
``WORDS`` rows, a constant. Rows whose bit is not set can have no match; only the others are shuffled
for the exact join. When keys are so many that all bits are set, every row takes that way.

Defined results: a null key is among no keys; an empty list of keys keeps no row (``with_keys``) or all
(``without_keys``); rows keep all their columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.store import fresh

WORDS = 1 << 18


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit("bit"), key)
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")


def marked(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` with one more column, whose name is returned, too: whether ``key`` may be among ``keys.key``."""
    w, b, bits, maybe = fresh(rows, "_w", "_b", "_bits", "_maybe")
    word, bit = _place(F.col("key"))
    set_ = keys.select(word.alias(w), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(b)).groupBy(w).agg(F.bit_or(b).alias(bits))
    word, bit = _place(F.col(key))
    met = rows.withColumn(w, word).withColumn(b, bit).join(F.broadcast(set_), w, "left")  # WORDS rows at most
    held = F.call_function("shiftrightunsigned", F.col(bits), F.col(b)).bitwiseAND(F.lit(1)) == 1
    return met.withColumn(maybe, F.coalesce(held, F.lit(False))).drop(w, b, bits), maybe


def with_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Inner join of rows on ``key`` with ``keys.key`` (and its further columns)."""
    some, maybe = marked(rows, key, keys)
    (mine,) = fresh(rows, "_key")
    return some.where(F.col(maybe)).drop(maybe).join(keys.withColumnRenamed("key", mine), F.col(key) == F.col(mine)).drop(mine)


def without_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not among ``keys.key``."""
    all_, maybe = marked(rows, key, keys)
    (mine,) = fresh(rows, "_key")
    rest = all_.where(F.col(maybe)).drop(maybe).join(keys.select(F.col("key").alias(mine)), F.col(key) == F.col(mine), "left_anti")
    return all_.where(~F.col(maybe)).drop(maybe).unionAll(rest)
