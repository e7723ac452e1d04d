"""Epochs of shuffled rows as a function of the slot.

An epoch is a permutation of 0..n-1 that a keyed Feistel network gives: a number is split as (high, low) in a grid of a x b >= n
cells, and each round adds a hash of one part to the other; numbers beyond n walk on until they are inside. So the row of a slot is
computed from the slot alone, and no task holds an epoch.

Slots run through epochs one after another and are cut in blocks (a block is a step). Where a block ends one epoch and
begins the next, rows could repeat in it. Then the first ``block`` rows of the new epoch are put in another order: those that the block
does not hold come first. That takes the ends of two epochs, at most ``block`` rows each, and leaves each epoch a permutation.

With fewer than two blocks of rows an epoch's end and begin would overlap; such a task runs through one and the same
permutation, in which any n slots in a row differ. With fewer rows than a block, rows repeat as they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALK, CHUNK = 4, 64, 4096


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def shuffled(i: Column, n: Column, *key: Column) -> Column:
    """The image of i under the permutation of 0..n-1 that the key names. n: a long of at least 1."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    part = lambda name, *of: F.xxhash64(F.lit(name), *key, *of)

    def mixed(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, b).alias("h"), (x % b).alias("l"))

        def one(acc: Column, k: Column) -> Column:
            def two(h: Column) -> Column:
                return F.struct(h.alias("h"), F.pmod(acc.l + F.pmod(part("low", k, h), b), b).alias("l"))

            return _let(F.pmod(acc.h + F.pmod(part("high", k, acc.l), a), a), two)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda acc: acc.h * b + acc.l)

    #: at most a - 1 cells lie outside, so a walk of WALK steps ends for n up to 4,096, and beyond it but for a chance of (1/64)^64
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), mixed(i), lambda acc, _: F.when(acc < n, acc).otherwise(mixed(acc)))
    return walked


def _rows_of_step(step: Column, n: Column, block: int, seed: str, task: Column) -> Column:
    """The rows of a step's slots."""
    first = step * block
    epoch_of = lambda s: F.call_function("div", s, n)
    at = lambda e, p: shuffled(p, n, F.lit(seed), task, F.when(n < 2 * block, F.lit(0).cast("long")).otherwise(e))
    numbers = lambda low, high: F.sequence(low, high - 1)

    def begin(e: Column) -> Column:
        """The first ``block`` rows of epoch e, those that its first block does not hold yet in front; null if the epoch begins with a block."""
        held = (e * n) % block
        seen = F.transform(numbers(n - held, n), lambda p: at(e - 1, p))
        head = F.transform(numbers(F.lit(0).cast("long"), F.lit(block).cast("long")), lambda p: at(e, p))
        both = F.struct(seen.alias("seen"), head.alias("head"))
        ordered = _let(both, lambda v: F.concat(F.array_except(v.head, v.seen), F.array_intersect(v.head, v.seen)))
        return F.when((n >= 2 * block) & (e > 0) & (held > 0), ordered)

    low, high = epoch_of(first), epoch_of(first + block - 1)
    begins = F.struct(F.when(first % n < block, begin(low)).alias("low"), F.when(high > low, begin(high)).alias("high"))

    def row(v: Column):
        def of(s: Column) -> Column:
            e, p = epoch_of(s), s % n
            moved = F.when(p < block, F.when(e == low, F.get(v.low, p.cast("int"))).when(e == high, F.get(v.high, p.cast("int"))))
            return F.coalesce(moved, at(e, p))

        return F.transform(F.sequence(first, first + block - 1), of)

    return _let(begins, row)


def epoch_slots(sizes: DataFrame, block: int, seed: str) -> DataFrame:
    """(task, step, slot, row_index) of every slot. sizes: task, size (rows), steps. Steps are dealt in chunks of CHUNK, each computed on its own."""
    rows = sizes.where("size > 0 and steps > 0").select("task", F.col("size").cast("long").alias("n"), F.col("steps").cast("long").alias("steps"))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("steps") / CHUNK).cast("long") - 1)))
    dealt = chunks.repartition("task", "chunk")  # a row per chunk
    steps = dealt.withColumn("step", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("steps")) - 1)))
    found = steps.select("task", "step", F.posexplode(_rows_of_step(F.col("step"), F.col("n"), block, seed, F.col("task"))).alias("slot", "row_index"))
    return found.select("task", "step", F.col("slot").cast("long").alias("slot"), "row_index")
