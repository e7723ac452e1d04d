"""Benchmark decontamination with DataFrame operations only.

1. Texts and items become words (lower case, split at ASCII white space) and five-word
   shingles. Similarity ignores the order of shingles, so every start counts, not only those
   where shared shingles stand at the item's own places. A window of an item's size is laid at
   every start where so many of its shingles are the item's that it can reach the threshold.
2. Windows and items get 64-bit SimHash fingerprints of their shingles (each as often as it
   occurs). Fingerprints are cut into ``BLOCKS`` blocks; two within ``RADIUS`` bits differ by
   at most RADIUS // BLOCKS bits in some block, and the items' side lists
   every such variant of each block, so the join finds all pairs within the radius. A window
   meets only the items it was laid for, so a large benchmark adds no random meetings.
3. Candidates are verified by the exact weighted similarity of their shingles: weights
   are numbers of occurrences, similarity is sum of minima / sum of maxima.

Only the benchmark may be broadcast, and only while it has at most ``BROADCAST_ROWS``
shingles; beyond that Spark joins by shuffling.

Defined results: null or empty texts have no windows; texts shorter than an item have
one window, the whole text; items of fewer than five words match nothing; very long texts and
items are read whole (windows of over ``LANE`` shingles are counted bit by bit); repeated rows of
a text count once per id; rows with a null id are judged, too, and come out under null; an empty table on either
side gives no rows. Further columns, whatever their names, are ignored by ``leaks`` and kept by ``drop_leaks``,
which judges each row by its own text, also where ids repeat or are null.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.keys import with_keys, without_keys
from sluice.llm.store import fresh, keep, row_name, table

WIDTH = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 two fingerprints differ in 9.7 bits on average, deviation 2.9.
RADIUS = 20
BLOCKS = 7
BROADCAST_ROWS = 1_000_000
#: Shingles that a 16-bit lane can count.
LANE = 65_535

_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingled(rows: DataFrame) -> DataFrame:
    """Add n (words) and sh (hash of the shingle at each word) to rows with ``text``.

    The words are bound to a lambda's variable, so they are split once a text."""

    def hashes(w: Column) -> Column:
        at = F.when(F.size(w) >= WIDTH, F.sequence(F.lit(0), F.size(w) - WIDTH)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.size(w).alias("n"), F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)])).alias("sh"))

    return rows.withColumn("_x", F.explode(F.transform(F.array(words_of(F.col("text"))), hashes))).select("*", "_x.*").drop("_x")


def simhash(shingles: Column) -> Column:
    """Bits set in over half the hashes: sixteen running sums of four 16-bit lanes."""

    def lane(b: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftright(h, b).bitwiseAND(F.lit(0x0001000100010001)))

    lanes = [lane(b) for b in range(16)]
    return F.struct(*[x.alias(f"l{b}") for b, x in enumerate(lanes)], F.size(shingles).alias("n"))


def _bits(lanes: str) -> Column:
    out = F.lit(0).cast("long")
    for b in range(16):
        for j in range(4):
            count = F.shiftrightunsigned(F.col(f"{lanes}.l{b}"), 16 * j).bitwiseAND(F.lit(0xFFFF))
            out = out.bitwiseOR(F.when(count * 2 > F.col(f"{lanes}.n"), F.lit((1 << (16 * j + b)) - (1 << 64 if 16 * j + b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _counted(shingles: Column) -> Column:
    """The same bits for any number of shingles, counted one bit after another."""

    def bit(acc: Column, b: Column) -> Column:
        has = F.size(F.filter(shingles, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)) == 1))
        return acc.bitwiseOR(F.when(has * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def with_fingerprint(rows: DataFrame, shingles: str = "sh") -> DataFrame:
    few = F.size(shingles) <= LANE
    laned = rows.withColumn("_lanes", simhash(F.when(few, F.col(shingles)).otherwise(F.array().cast("array<long>"))))
    return laned.withColumn("fp", F.when(few, _bits("_lanes")).otherwise(_counted(F.col(shingles)))).drop("_lanes")


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, _EDGES[k]).bitwiseAND(F.lit((1 << (_EDGES[k + 1] - _EDGES[k])) - 1))


def item_index(items: DataFrame) -> DataFrame:
    """block and key for every variant of every block within RADIUS // BLOCKS bits."""

    def variants(k: int) -> Column:
        width = _EDGES[k + 1] - _EDGES[k]
        masks = [sum(1 << b for b in some) for r in range(RADIUS // BLOCKS + 1) for some in combinations(range(width), r)]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k).bitwiseXOR(m).alias("key")))

    return items.select("item_id", "size", F.col("fp").alias("item_fp"), F.explode(F.concat(*[variants(k) for k in range(BLOCKS)])).alias("x")).select("item_id", "size", "item_fp", "x.*")


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def laid_starts(at: Column, n: Column, size: Column, threshold: float) -> Column:
    """Starts of all windows that can reach ``threshold``. at: the sorted places of a text of n words
    whose shingles an item of ``size`` words has.

    Of T shingles in a window and S in an item at least threshold * (T + S) / (1 + threshold) are
    common, so a window holds ``need`` places in a row, the i-th to the last of them. The starts
    that hold them from the i-th are a range; what the range before has is left out of it."""
    total = F.least(n, size) - (WIDTH - 1)
    need = F.greatest(F.lit(1), F.ceil(threshold * (total + size - (WIDTH - 1)) / (1 + threshold) - 1e-9).cast("int"))
    last = F.greatest(F.lit(0), n - size)

    def starts(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(at, i + need - 1) - total + 1, F.coalesce(F.get(at, i - 1), F.lit(-1)) + 1)
        high = F.least(F.get(at, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    firsts = F.when(F.size(at) >= need, F.sequence(F.lit(0), F.size(at) - need)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(firsts, starts))


def leaking_windows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """k (a row's name), doc_id, item_id, start, size, aligned, similarity of every window found at ``threshold`` or more.

    docs: doc_id, text; items: item_id, text; further columns are ignored.
    """
    items = shingled(items.select("item_id", "text")).where("size(sh) > 0").select("item_id", F.col("n").alias("size"), "sh")
    items = keep(with_fingerprint(items), "items")
    item_sh = items.select("item_id", "size", F.posexplode("sh").alias("q", "h"))
    n_sh, n_items = items.agg(F.coalesce(F.sum(F.size("sh")), F.lit(0)), F.count(F.lit(1))).first()

    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64(row_name("doc_id", "text")))
    found = shingled(docs).select("k", "n", F.posexplode("sh").alias("p", "h"))
    hits = found.join(_small(item_sh, n_sh), "h")
    own_place = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("size")))
    met = hits.groupBy("k", "n", "item_id", "size").agg(F.sort_array(F.collect_set("p")).alias("at"), F.collect_set(own_place).alias("own"))  # a text's words at most
    met = met.select("k", "item_id", "size", "own", F.explode(laid_starts(F.col("at"), F.col("n"), F.col("size"), threshold)).alias("start"))
    laid = keep(met.select("k", "item_id", "size", "start", F.array_contains("own", F.col("start")).alias("aligned")), "windows")

    #: texts with a window, each with its shingles; a window is a slice of them. Other texts
    #: are left out by a bitmap of bounded size before any text is shuffled
    wanted = laid.groupBy("k").agg(F.collect_set(F.struct("size", "start")).alias("laid"))
    met = shingled(with_keys(docs, "k", wanted.withColumnRenamed("k", "key"))).select("k", "doc_id", "sh", F.explode("laid").alias("x")).select("k", "doc_id", "x.size", "x.start", F.slice("sh", F.col("x.start") + 1, F.greatest(F.lit(1), F.col("x.size") - (WIDTH - 1))).alias("sh"))
    windows = keep(with_fingerprint(met.dropDuplicates(["k", "doc_id", "size", "start"])), "fingerprints")

    laid_for = windows.join(laid, ["k", "size", "start"])
    keyed = laid_for.select("k", "doc_id", "item_id", "size", "start", "aligned", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("key")) for b in range(BLOCKS)])).alias("x")).select("k", "doc_id", "item_id", "size", "start", "aligned", "fp", "x.*")
    index = _small(item_index(items).drop("size"), n_items * BLOCKS * 64)
    near = keyed.join(index, ["item_id", "block", "key"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = near.select("k", "doc_id", "size", "start", "item_id", "aligned").distinct()

    own = pairs.join(windows.select("k", "size", "start", "sh").dropDuplicates(["k", "size", "start"]), ["k", "size", "start"])
    left = own.select("k", "doc_id", "size", "start", "aligned", "item_id", F.size("sh").alias("total"), F.explode("sh").alias("h")).groupBy("k", "doc_id", "size", "start", "aligned", "item_id", "total", "h").agg(F.count(F.lit(1)).alias("a"))
    right = item_sh.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("b"))
    sizes = items.select("item_id", F.size("sh").alias("item_total"))
    both = left.join(_small(right, n_sh), ["item_id", "h"]).groupBy("k", "doc_id", "size", "start", "aligned", "item_id", "total").agg(F.sum(F.least("a", "b")).alias("common"))
    scored = both.join(_small(sizes, n_sh), "item_id").withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")))
    return scored.where(F.col("similarity") >= threshold)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (word), size (words), similarity: the best window of every
    document and item with a window at ``threshold`` or more; of equal ones one that has a shared
    shingle at the item's own place, then the first."""
    best = F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("back"), "size"))
    return leaking_windows(docs, items, threshold).groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", (-F.col("x.back")).cast("int").alias("start"), "x.size", "x.similarity")


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows whose text holds a window of an item."""
    (mine,) = fresh(docs, "_name")
    named = lambda k, c: F.concat_ws(":", F.coalesce(F.col(c).cast("string"), F.lit("null")), k)
    bad = keep(leaking_windows(docs, items, threshold).select(named(F.col("k"), "doc_id").alias("key")).distinct(), "leaked")
    return without_keys(docs.withColumn(mine, named(F.xxhash64(row_name("doc_id", "text")), "doc_id")), mine, bad).drop(mine)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
