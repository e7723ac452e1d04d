"""SimHash near-duplicate groups through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 two-bit segments; their popcounts are a point on
a grid, and the Manhattan distance of two points is at most the Hamming distance of
the fingerprints. Within Hamming distance 3, one of the two 16-segment halves
therefore lies within Manhattan distance 1 (pigeonhole), so the range join looks at
each half's own cell and its neighbours one step down, and then verifies exactly.
No bucket is capped: a crowded cell is linked in tiles, and gives a spanning forest
of its links and not all pairs.

Defined results: null or empty text has fingerprint zero and links like any other;
equal fingerprints are one vertex however many rows share them; rows with a null id
get their group's smallest id, too; an empty table gives no rows. A very long text is read whole, about
2 MB of texts (or one text) at a time. Columns other than the id and the text are ignored by the query and
kept by ``first_of_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.components import connected_components
from sluice.llm.keys import with_keys, without_keys
from sluice.llm.store import fresh, keep, slots, table
from sluice.llm.wordbytes import Words, pieces

RADIUS = 3
SEED = 42
#: Cells of up to so many fingerprints are compared together, larger ones in tiles.
SMALL_CELL = 48
_LANES = np.uint64(0x0101010101010101)


def bit_majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of groups of hashes: a bit is 1 if set in over half of the group.
    ``first`` has each group's start and, last, the number of hashes."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), dtype=np.uint64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    #: byte lanes hold up to 255, so groups are summed in runs of 255
    runs = -(-sizes[rows] // 255)
    run_first = np.concatenate([[0], np.cumsum(runs)])
    within = np.arange(run_first[-1]) - np.repeat(run_first[:-1], runs)
    starts = np.repeat(first[:-1][rows], runs) + within * 255
    for b in range(8):
        lanes = (hashes >> np.uint64(b)) & _LANES
        part = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(part, run_first[:-1], axis=0)
        over = 2 * total > sizes[rows][:, None]
        for j in range(8):
            out[rows] |= over[:, j].astype(np.uint64) << np.uint64(8 * j + b)
    return out


def shingle_hashes(texts: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, start of each text's shingles and, last, their number).
    A text of fewer words has its whole sequence as its only shingle; without words none."""
    from xxhash import xxh64_intdigest as xxh

    words = Words(texts)
    joined, starts, ends = words.joined()
    counts = np.where(words.counts >= width, words.counts - width + 1, np.minimum(words.counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], counts)
    last = np.minimum(at + width - 1, np.repeat(words.first[1:], counts) - 1)
    hashes = np.fromiter((xxh(joined[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[last].tolist())), dtype=np.uint64, count=len(at))
    return hashes, first


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = bit_majority(*shingle_hashes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(got.view(np.int64))], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def popcounts(fp, half: int):
    """The counts of the 16 two-bit segments of a half, two bits each."""
    bits = F.shiftright(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return bits - F.shiftright(bits, 1).bitwiseAND(F.lit(0x55555555))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for all but the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _tiles(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links among distinct values, 512 rows at a time."""
    a, b = [], []
    for at in range(0, len(values), 512):
        near = np.bitwise_count(values[at : at + 512, None] ^ values[None, at:]) <= radius
        i, j = np.nonzero(np.triu(near, 1))
        if len(i):
            v, r = forest(values[at + i], values[at + j])
            a.append(v)
            b.append(r)
    if not a:
        return values[:0], values[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def link_cell(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one crowded cell. Beyond 4,096 values equal
    quarters (one of four is equal within distance 3) part the cell first."""
    values = np.unique(values)
    if len(values) <= 4096 or radius > 3:
        return _tiles(values, radius)
    a, b = [], []
    for q in range(4):
        key = (values >> np.uint64(16 * q)) & np.uint64(0xFFFF)
        order = np.argsort(key, kind="stable")
        for part in np.split(values[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                v, r = _tiles(part, radius)
                a.append(v)
                b.append(r)
    return forest(np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def link_cells(half: np.ndarray, cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in rows sorted by (half, cell)."""
    edge = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(half) != 0)) + 1, [len(cell)]])
    size = np.diff(edge)
    a, b = [fp[:0]], [fp[:0]]
    small = np.repeat((size > 1) & (size <= SMALL_CELL), size)
    group = np.repeat(np.arange(len(size)), size)[small]
    values = fp[small]
    for shift in range(1, min(SMALL_CELL, len(values))):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        near = np.flatnonzero(same & (np.bitwise_count(values[shift:] ^ values[:-shift]) <= radius))
        a.append(values[near])
        b.append(values[near + shift])
    for k in np.flatnonzero(size > SMALL_CELL):
        v, r = link_cell(fp[edge[k] : edge[k + 1]], radius)
        a.append(v)
        b.append(r)
    return forest(np.concatenate(a), np.concatenate(b))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius``."""
    if radius > 3:
        raise ValueError("two halves one step apart cover a radius of 3 at most")
    halves = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), popcounts(F.col("fp"), h).alias("vec")) for h in (0, 1)])).alias("x")).select("fp", "x.*")
    #: the cell itself, and the 16 cells one step down in a segment that isn't empty
    steps = [F.when(F.shiftright("vec", 2 * s).bitwiseAND(F.lit(3)) > 0, F.col("vec") - (1 << (2 * s))) for s in range(16)]
    rows = halves.select("fp", "half", F.explode(F.array_compact(F.array(F.col("vec"), *steps))).alias("cell"))
    n = slots(distinct.sparkSession)
    dealt = rows.repartition(n, "half", "cell").sortWithinPartitions("half", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0

        def flush(keep_last: bool):
            nonlocal held, rows_held
            part = pa.Table.from_batches(held)
            half, cell, fp = (part.column(c).to_numpy() for c in ("half", "cell", "fp"))
            stop = len(cell)
            if keep_last:
                stop = np.flatnonzero((cell != cell[-1]) | (half != half[-1]))
                stop = int(stop[-1]) + 1 if len(stop) else 0
            held = part.slice(stop).combine_chunks().to_batches() if stop < len(cell) else []
            rows_held = len(cell) - stop
            v, r = link_cells(half[:stop], cell[:stop], fp[:stop].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(r.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows_held += batch.num_rows
                if rows_held >= 200_000:
                    yield flush(True)
        if held:
            yield flush(False)

    return dealt.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, radius: int, id_col: str) -> DataFrame:
    marked = keep(fingerprints(docs, id_col), "fingerprints")
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    member = distinct.join(roots, distinct.fp == roots.v, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable over links) of every row."""
    return _grouped(docs, radius, id_col).select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: its smallest (id, text hash). All columns stay, whatever their names."""
    name = lambda i, h: F.concat_ws(":", F.coalesce(F.col(i).cast("long").cast("string"), F.lit("null")), h)
    (mine,) = fresh(docs, "_place")
    got = _grouped(docs, radius, id_col).select("doc_id", "h", "root")
    rows = got.groupBy("doc_id", "h", "root").agg(F.count(F.lit(1)).alias("n")).withColumn("key", name("doc_id", "h"))
    #: a group's smallest is a partial minimum and meets rows by their own names, so no row meets its group
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "h", "key")
    stay = rows.groupBy("root").agg(F.min(place).alias("least")).select("least.key", F.lit(True).alias("stays"))
    rows = keep(rows.select("key", "n").join(stay, "key", "left").select("key", F.coalesce("stays", F.lit(False)).alias("stays"), "n"), "places")
    keyed = docs.withColumn(mine, name(id_col, F.xxhash64("text")))
    kept = without_keys(keyed, mine, rows.where("not stays").select("key"))
    #: of rows that are repeated as they are, one stays; others are not shuffled for that
    repeated = rows.where("stays and n > 1").select("key")
    if repeated.limit(1).count():
        kept = without_keys(kept, mine, repeated).unionAll(with_keys(kept, mine, repeated).dropDuplicates([mine]))
    return kept.drop(mine)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
