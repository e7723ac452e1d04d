"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document's tokens (plus an end id) are cut into pieces of at most ``capacity``
tokens, the first piece taking the remainder. Pieces are then placed one by one:
with N(g) open bins of residual gap g, a piece goes where the sum of N(g)^2 over
1 <= g < capacity becomes smallest (a new bin counts as gap ``capacity``).

The rule looks at lengths only, so rows are dealt over shards by a hash of their place in the input (ids may
repeat) and every shard is packed on its own: a shard leaves at most a few half-filled bins,
which are negligible against its thousands of full ones. Only (id, piece, length)
is shuffled.

Defined results: null or empty text is one piece holding just the end id; a very long text becomes as
many pieces as it needs and is never held as ids of more than its own length; repeated
rows are packed each on its own, and a third of all rows may share an id; an empty table gives no rows;
extra columns are ignored, whatever their names; ties go to the smallest gap.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import fresh, keep, table
from sluice.llm.wordbytes import pieces

#: Pieces that one shard packs; bounds a task's memory.
SHARD_PIECES = 65_536


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # N(g)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bin_of = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        best, gap = far, capacity
        if size < capacity:
            here = count[size:capacity]
            #: leaving gap g takes 2N(g)-1 away, reaching gap g-size adds 2N(g-size)+1, a closed bin nothing
            change = 2 * count[: capacity - size] + 1 - (2 * here - 1)
            change[0] = 1 - 2 * here[0]
            change[here == 0] = far
            at = int(change.argmin())
            best, gap = int(change[at]), size + at
            if best > 2 * count[capacity - size] + 1:
                gap = capacity
            elif best == far:
                gap = capacity
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bin_of[i], offset[i] = b, capacity - gap
        rest = gap - size
        if rest:
            open_bins[rest].append(b)
            count[rest] += 1
    return bin_of, offset


def close_bins(lengths: np.ndarray, bin_of: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the least filled bins while all their pieces fit gaps of other bins."""
    if not len(lengths):
        return bin_of
    load = np.bincount(bin_of, weights=lengths).astype(np.int64)
    gaps = sorted((int(capacity - x), int(b)) for b, x in enumerate(load) if x < capacity)
    members: dict[int, list[int]] = {b: [] for _, b in gaps}
    for i, b in enumerate(bin_of.tolist()):
        if b in members:
            members[b].append(i)
    bin_of = bin_of.copy()
    while len(gaps) > 1:
        _, gone = gaps.pop()
        moved, trial = [], list(gaps)
        for i in sorted(members[gone], key=lambda i: -lengths[i]):
            at = bisect.bisect_left(trial, (int(lengths[i]), -1))
            if at == len(trial):
                return bin_of
            gap, b = trial.pop(at)
            moved.append((i, b))
            bisect.insort(trial, (gap - int(lengths[i]), b))
        for i, b in moved:
            bin_of[i] = b
            members[b].append(i)
        gaps = [g for g in trial if g[0]]
    return bin_of


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of lengths, sum-of-squares first, then ``close_bins``; longest
    lengths should come first."""
    bin_of = close_bins(lengths, sum_of_squares(lengths, capacity)[0], capacity)
    order = np.argsort(bin_of, kind="stable")
    run = np.cumsum(lengths[order]) - lengths[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = np.diff(bin_of[order]) != 0
    offset = np.empty(len(lengths), dtype=np.int64)
    offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
    return bin_of, offset


def cut_lengths(n: int, capacity: int) -> list[int]:
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, tokenizer: tuple[str, str | None], capacity: int, end_id: int, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from sluice.llm.bpe import ByteBpe

        coder = ByteBpe(*tokenizer)
        for batch in pieces(batches):
            who, piece, start, length, crc = [], [], [], [], []
            for d, ids in enumerate(coder.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for k, size in enumerate(cut_lengths(len(ids), capacity)):
                    who.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size]))
                    at += size
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(who, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length; other columns of these two
    names are replaced, all others stay."""
    rows = rows.drop("sequence_id", "offset")
    shards = max(1, -(-rows.count() // shard_pieces))
    fields = rows.schema
    names = fields.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held).combine_chunks()
        bin_of, offset = pack_lengths(part.column("length").to_numpy(), capacity)
        base = part.column(mine).to_numpy().astype(np.int64) << 32
        part = part.drop_columns([mine]).append_column("sequence_id", pa.array(base + bin_of)).append_column("offset", pa.array(offset))
        yield from part.to_batches(max_chunksize=65_536)

    (mine,) = fresh(rows, "_shard")
    dealt = rows.withColumn(mine, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    order = [F.col("length").desc(), "doc_id", "piece", *[c for c in names if c not in ("length", "doc_id", "piece")]]
    #: one partition may be dealt several shards; each is packed as a group of its own
    grouped = dealt.repartition(shards, mine).sortWithinPartitions(mine, *order)

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(mine).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column(mine)[0].as_py() != int(shard[a]):
                    yield from place(iter(held))
                    held = []
                held.append(batch.slice(a, b - a))
        yield from place(iter(held))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return grouped.mapInArrow(by_shard, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: tuple[str, str | None], capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens."""
    return pack(keep(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), default_tokenizer())
