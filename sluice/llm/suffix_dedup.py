"""Removal of long repeated byte strings by column-wise suffix construction.

A byte goes if it lies in a ``length``-byte string that also starts elsewhere in the
collection. Inserting one symbol per document each round into one sorted order of all
suffixes takes as many rounds as the longest document has bytes and passes over the
whole order each time, so the collection is first parted, without loss, into small
collections whose members are short and aligned:

1. Every window of ``length`` bytes has a smallest k-gram (its anchor). Windows that
   share an anchor's place make a run, and equal windows lie in runs of the same anchor
   value at the same distance from it.
2. Runs that are equal byte for byte are found by a 128-bit hash with partial
   aggregation; all their bytes are repeated.
3. What remains are distinct runs of anchors that occur in two or more of them. Each
   such group is a collection of at most 2*length documents' bytes, aligned at the anchor. It is
   built column by column, right to left: each round inserts one symbol per document,
   updates the order of the suffixes that start in that column (the column's part of
   the collection's Burrows-Wheeler transform is the symbol column in that order) and
   their common prefixes with their neighbours. Strings at different distances
   from the anchor cannot be equal, so no order across columns is needed.
   All groups of a task go through the same rounds; symbols are kept column by column in
   a sequential file when they outgrow memory.
4. Runs of very common anchors (a frequent line in a third of all texts) are parted
   once more by blocks of columns and a hash of the bytes that all windows of the block
   hold, which again loses nothing. Parts that are equal are found by their hash with partial
   aggregation, as in 2; blocks that still hold too many different parts are cut into narrower
   ones, in the end of one window. So no collection has more than ``COMMON`` documents.

Defined results: null or empty text has no bytes; texts shorter than ``length`` lose
nothing; an exact copy loses all if it has ``length`` bytes; repeated rows (same id)
are occurrences of their own; an empty table gives no rows. A very long text is read whole, about 8 MB of texts (or
one text) at a time, and its runs are short whatever its length. Columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import keep, slots, table
from sluice.llm.wordbytes import pieces, text_bytes

GRAM = 16
#: Distinct runs of an anchor, or parts of runs of a block, beyond which they are parted by narrower blocks.
COMMON = 2048
#: Columns in a block, level by level; a block of one column holds equal windows only.
BLOCKS = (50, 10, 1)
#: Bytes of symbols kept in memory before they go to a file.
IN_MEMORY = 96 << 20
#: Documents whose columns one set of rounds builds.
ROUND_ROWS = 60_000
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POS_BITS = np.uint64(31)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes that start at each place (the last 15 places fall off)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    h = eight[:n] * _M1
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n]
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring keys (van Herk / Gil-Werman)."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - width + 1
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor place: (text, first window, number of
    windows, anchor's distance from the first window, anchor hash)."""
    width = length - GRAM + 1
    grams = gram_hashes(data)
    if len(grams) < width:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, np.zeros(0, dtype=np.uint64)
    #: order by hash, then by place, so that the choice depends on content alone
    keys = (grams >> _POS_BITS << _POS_BITS) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_argmin(keys, width)
    place = (low & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
    # windows that reach beyond their text don't count
    count = len(place)
    inside = np.zeros(count, dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a : b - length + 1] = True
    start = inside.copy()
    start[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    fresh = np.zeros(count + 1, dtype=bool)
    fresh[offsets[offsets <= count]] = True
    start |= inside & fresh[:count]
    first = np.flatnonzero(start)
    stop = inside.copy()
    stop[:-1] &= start[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, first - offsets[text], last - first + 1, place[first] - first, grams[place[first]]


def runs(docs: DataFrame, length: int) -> DataFrame:
    """rid, start, n (windows), off, mini, h1, h2 of every run of every text. Equal runs of one text are one row, with
    their number (``times``) and the bytes they cover (``spans``), so a text that repeats itself is no hot key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in pieces(batches, limit=8 << 20):
            data, offsets = text_bytes(batch.column("text"))
            text, first, n, off, mini = anchor_runs(data, offsets, length)
            if not len(text):
                continue
            at = offsets[text] + first
            raw = data.tobytes()
            #: the distance is hashed too, so equal hashes mean equal bytes at equal places
            digest = b"".join([xxh3_128_digest(raw[a:b], s) for a, b, s in zip(at.tolist(), (at + n + length - 1).tolist(), off.tolist())])
            h = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
            order = np.lexsort((first, h[:, 1], h[:, 0], text))
            text, first, h = text[order], first[order], h[order]
            end = first + n[order] + length - 1
            head = np.ones(len(text), dtype=bool)
            head[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]).any(axis=1)
            cut = head.copy()
            cut[1:] |= first[1:] > end[:-1]
            heads, cuts = np.flatnonzero(head), np.flatnonzero(cut)
            spans = pa.StructArray.from_arrays([pa.array(first[cuts].astype(np.int32)), pa.array(end[np.append(cuts[1:] - 1, len(text) - 1)].astype(np.int32))], names=["begin", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(cuts, np.append(heads, len(text))).astype(np.int32)), spans)
            pick = order[heads]
            ints = [pa.array(x.astype(np.int32)) for x in (first[heads], n[pick], off[pick])]
            times = pa.array(np.diff(np.append(heads, len(text))))
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(text[heads])), *ints, pa.array(mini[pick].view(np.int64)), pa.array(h[heads, 0]), pa.array(h[heads, 1]), times, spans], names=["rid", "start", "n", "off", "mini", "h1", "h2", "times", "spans"])

    return docs.select("rid", "text").mapInArrow(find, "rid long, start int, n int, off int, mini long, h1 long, h2 long, times long, spans array<struct<begin:int,end:int>>")


class Columns:
    """Symbols of aligned documents, column by column, in memory or in a file."""

    def __init__(self, rows: int, columns: int):
        self.rows = rows
        if rows * columns <= IN_MEMORY:
            self.held, self.file = np.zeros((columns, rows), dtype=np.uint8), None
        else:
            self.file = tempfile.TemporaryFile()  # gone as soon as it is closed
            self.held = np.memmap(self.file, dtype=np.uint8, mode="w+", shape=(columns, rows))

    def fill(self, values: list[bytes], at: np.ndarray) -> None:
        for lo in range(0, self.rows, 4096):
            hi = min(self.rows, lo + 4096)
            block = np.zeros((hi - lo, self.held.shape[0]), dtype=np.uint8)
            for k in range(lo, hi):
                block[k - lo, at[k] : at[k] + len(values[k])] = np.frombuffer(values[k], dtype=np.uint8)
            self.held[:, lo:hi] = block.T

    def close(self) -> None:
        del self.held
        if self.file:
            self.file.close()


def repeated_windows(group: np.ndarray, values: list[bytes], shift: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(document, window start in it) of every window that another document of the same
    group holds in the same column.

    group: ascending; shift: the column at which each document starts. Each round
    inserts the symbols of one column, from the last to the first. ``order`` lists
    documents by (group, suffix from this column); ``lcp[i]`` is the common prefix of the
    suffixes at i-1 and i. A document's suffix is empty beyond its end, and an
    empty suffix shares nothing with any other.
    """
    rows = len(values)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=rows)
    ends = shift + sizes
    columns = int(ends.max())
    symbols = Columns(rows, columns)
    symbols.fill(values, shift)
    group = group.astype(np.int64)
    order = np.arange(rows)
    edge = np.zeros(rows, dtype=bool)
    edge[0] = True
    edge[1:] = group[1:] != group[:-1]
    lcp = np.zeros(rows, dtype=np.int64)
    found: list[tuple[np.ndarray, int]] = []
    ordinal = np.cumsum(edge) - 1
    wide = ordinal[-1] >= 1 << 16
    small = ordinal.astype(np.uint16)
    for column in range(columns - 1, -1, -1):
        symbol = symbols.held[column]
        alive = (column >= shift) & (column < ends)
        #: stable insertion: by group, then symbol, then the order of the column behind
        now = symbol[order].astype(np.uint16)
        now[alive[order]] += 1
        step = np.argsort(now, kind="stable")
        where = ordinal[order[step]]
        step = step[np.argsort(where if wide else where.astype(np.uint16), kind="stable")]
        #: common prefix of neighbours with equal symbols: one more than the least between their old places
        new_order = order[step]
        new_lcp = np.zeros(rows, dtype=np.int64)
        same = np.zeros(rows, dtype=bool)
        key = now[step]
        live = alive[new_order]
        same[1:] = (key[1:] == key[:-1]) & (ordinal[new_order[1:]] == ordinal[new_order[:-1]]) & live[1:] & live[:-1]
        at = np.flatnonzero(same)
        if len(at):
            new_lcp[at] = 1 + _range_min(lcp, step[at - 1] + 1, step[at])
        order, lcp = new_order, new_lcp
        hit = lcp >= length
        if hit.any():
            both = hit.copy()
            both[:-1] |= hit[1:]
            found.append((order[both], column))
    symbols.close()
    return [(int(d), int(column - shift[d])) for docs, column in found for d in docs]


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) (both ends count) of many ranges with lo <= hi."""
    near = hi == lo
    out = values[hi].copy()
    far = np.flatnonzero(~near)
    if len(far):
        # ranges ascend within each symbol, so one sparse table over the column serves all
        span = hi[far] - lo[far] + 1
        level = np.int64(0)
        table = values
        power = np.floor(np.log2(span)).astype(np.int64)
        for level in range(int(power.max()) + 1):
            pick = far[power == level]
            if len(pick):
                out[pick] = np.minimum(table[lo[pick]], table[hi[pick] - (1 << level) + 1])
            if (1 << level) < len(values):
                table = np.minimum(table, np.concatenate([table[1 << level :], table[-(1 << level) :]]))
    return out


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes covered by windows at ascending starts: (begins, ends) of maximal runs."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def _build(groups: DataFrame, length: int) -> DataFrame:
    """groups: key, own (whether its bytes are to be reported), rid, start, shift, data,
    sorted by key in each partition. Rows rid, begin, end of repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            part = pa.Table.from_batches(held).combine_chunks()
            key = part.column("key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            stop = len(key)
            if not last:
                change = np.flatnonzero(np.diff(key))
                stop = int(change[-1]) + 1 if len(change) else 0
            held = part.slice(stop).to_batches() if stop < len(key) else []
            rows = len(key) - stop
            if not stop:
                return None
            part = part.slice(0, stop)
            values = part.column("data").to_pylist()
            shift = part.column("shift").to_numpy().astype(np.int64)
            hits = repeated_windows(key[:stop], values, shift - shift.min(), length)
            if not hits:
                return None
            hits = np.array(hits, dtype=np.int64)
            hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
            own = part.column("own").to_numpy(zero_copy_only=False)
            begin0 = part.column("start").to_numpy()
            who, begin, end = [], [], []
            for d in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1):
                k = int(d[0, 0])
                if own[k]:
                    b, e = _spans(d[:, 1], length)
                    who += [k] * len(b)
                    begin.append(b + begin0[k])
                    end.append(e + begin0[k])
            if not who:
                return None
            return pa.RecordBatch.from_arrays([part.column("rid").combine_chunks().take(pa.array(who)), pa.array(np.concatenate(begin).astype(np.int32)), pa.array(np.concatenate(end).astype(np.int32))], names=["rid", "begin", "end"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= ROUND_ROWS and (out := flush(False)) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out

    return groups.mapInArrow(run, "rid long, begin int, end int")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with their wanted runs (rid, start, n, off, key, own), so that a text meets them once."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "off", "key", "own")).alias("wanted"))
    return docs.select("rid", "text").join(lists, "rid")


def _values(batch: pa.RecordBatch, length: int) -> tuple[pa.Array, dict, list[bytes]]:
    """rid of every wanted run, its fields, and its bytes."""
    data, offsets = text_bytes(batch.column("text"))
    raw = data.tobytes()
    lists = batch.column("wanted")
    flat = lists.flatten()
    text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    field = {f: flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n", "off")} | {f: flat.field(f) for f in ("key", "own")}
    at = offsets[text] + field["start"]
    values = [raw[a:b] for a, b in zip(at.tolist(), (at + field["n"] + length - 1).tolist())]
    return batch.column("rid").take(pa.array(text)), field, values


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs, aligned at their anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rids, field, values = _values(batch, length)
            yield pa.RecordBatch.from_arrays([field["key"], field["own"], rids, pa.array(field["start"].astype(np.int32)), pa.array((length - field["off"]).astype(np.int32)), pa.array(values, pa.binary())], names=["key", "own", "rid", "start", "shift", "data"])

    return _with_texts(docs, wanted).mapInArrow(cut, "key binary, own boolean, rid long, start int, shift int, data binary")


def _parts(docs: DataFrame, wanted: DataFrame, length: int, width: int) -> DataFrame:
    """Wanted runs cut at blocks of ``width`` columns (distances of a window's start from the anchor). All windows
    of a block hold its core, so equal windows have equal keys: a hash of the run's key, block and core.
    ``same`` is a hash of the part's bytes and place in the block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in pieces(batches):
            rids, field, values = _values(batch, length)
            rows, keys, same, starts, ns, offs = [], [], [], [], [], []
            for k, (value, key, start, n, off) in enumerate(zip(values, field["key"].to_pylist(), field["start"].tolist(), field["n"].tolist(), field["off"].tolist())):
                first, last = -off, n - off - 1
                for block in range(first // width, last // width + 1):
                    lo, hi = max(first, block * width), min(last, block * width + width - 1)
                    core = value[block * width + width - 1 - first : block * width + length - first]
                    rows.append(k)
                    keys.append(xxh3_128_digest(b"%d:%d:%b:%b" % (width, block, key, core)))
                    same.append(xxh3_128_digest(value[lo - first : hi - first + length], lo - block * width))
                    starts.append(start + lo - first)
                    ns.append(hi - lo + 1)
                    offs.append(-lo)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(same, pa.binary()), field["own"].take(rows), rids.take(rows), *[pa.array(x, pa.int32()) for x in (starts, ns, offs)]], names=["key", "same", "own", "rid", "start", "n", "off"])

    return _with_texts(docs, wanted).mapInArrow(cut, "key binary, same binary, own boolean, rid long, start int, n int, off int")


def _narrow(docs: DataFrame, wide: DataFrame, length: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Runs of common anchors, block by block: spans that are repeated, and parts to build from (as ``wanted``)."""
    spans = open_ = None
    for width in BLOCKS:
        if not wide.limit(1).count():
            break
        parts = keep(_parts(docs, wide, length, width), "parts")
        kinds = keep(parts.groupBy("key", "same").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "start", "n", "off")).alias("at"), F.max("own").alias("own")), "part_kinds")
        stop = (F.col("start") + F.col("n") + F.lit(length - 1)).cast("int")
        found = parts.join(kinds.where("copies > 1").select("key", "same"), ["key", "same"]).select("rid", F.col("start").alias("begin"), stop.alias("end"))
        spans = found if spans is None else spans.unionAll(found)
        alone = F.col("copies") == 1
        shared = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("distinct"), F.max(alone & F.col("own")).alias("open")).where("distinct > 1 and open").drop("open")
        left = keep(kinds.join(shared, "key").select("key", (alone & F.col("own")).alias("own"), "distinct", "at.*"), "part_groups")
        few = left.where(F.col("distinct") <= COMMON).drop("distinct")
        open_ = few if open_ is None else open_.unionByName(few)
        wide = left.where(F.col("distinct") > COMMON).drop("distinct")
    return spans, open_


def _merge(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals (those that touch are one)."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(begins[1:] > ends[:-1])
    return begins[np.concatenate([[0], cut + 1])], ends[np.concatenate([cut, [len(ends) - 1]])]


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs: rid (unique), text. Rows rid, begin, end (bytes) whose union is repeated."""
    n = slots(docs.sparkSession)
    found = keep(runs(docs, length), "runs")
    first = F.min(F.struct("rid", "start", "n", "off"))
    kinds = keep(found.groupBy("mini", "h1", "h2").agg(F.sum("times").alias("copies"), first.alias("at")), "kinds")
    copied = kinds.where("copies > 1").select("mini", "h1", "h2")
    spans = found.join(copied, ["mini", "h1", "h2"]).select("rid", F.explode("spans").alias("span")).select("rid", "span.begin", "span.end")
    shared = kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("distinct"), F.max(F.when(F.col("copies") == 1, 1)).alias("open")).where("distinct > 1 and open = 1").drop("open")
    runs_left = keep(kinds.join(shared, "mini").select(F.encode(F.col("mini").cast("string"), "utf-8").alias("key"), (F.col("copies") == 1).alias("own"), "distinct", "at.*"), "groups")
    wanted = runs_left.where(F.col("distinct") <= COMMON).drop("distinct")
    more, parts = _narrow(docs, runs_left.where(F.col("distinct") > COMMON).drop("distinct"), length)
    if parts is not None:
        spans, wanted = spans.unionAll(more), wanted.unionByName(parts)
    groups = _fetch(docs, wanted, length)
    if n > 1:
        groups = groups.repartition(n, "key")
    return spans.unionAll(_build(groups.sortWithinPartitions("key", "rid", "start"), length))


def with_row_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A kept copy of (rid, doc_id, text), bucketed by rid so that later joins leave
    the texts where they are."""
    spark = docs.sparkSession
    name = f"sluice_texts_{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    #: ids are made once, in the same job that writes them
    n = slots(spark)
    rows.withColumn("rid", F.monotonically_increasing_id()).repartition(n, "rid").write.bucketBy(n, "rid").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def suffix_dedup(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts elsewhere, too.

    Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also ``kept``
    (the remaining bytes) and ``spans`` (begin, end in bytes).
    """
    held = with_row_ids(docs)
    spans = repeated_spans(held, length).groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    met = held.join(spans, "rid", "left")
    more = ", kept binary, spans array<struct<begin:long,end:long>>" if texts else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            lists = batch.column("spans")
            removed, runs_, sha, kept, out = [], [], [], [], []
            bounds = lists.offsets.to_numpy()
            begin = lists.values.field("begin").to_numpy(zero_copy_only=False).astype(np.int64)
            end = lists.values.field("end").to_numpy(zero_copy_only=False).astype(np.int64)
            for d in range(batch.num_rows):
                a, b = int(offsets[d]), int(offsets[d + 1])
                lo, hi = bounds[d], bounds[d + 1]
                b0 = e0 = np.zeros(0, dtype=np.int64)
                rest = raw[a:b]
                if hi > lo:
                    b0, e0 = _merge(begin[lo:hi], end[lo:hi])
                    edges = [0, *np.stack([b0, e0], 1).reshape(-1).tolist(), b - a]
                    rest = b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2]))
                removed.append(b - a - len(rest))
                runs_.append(len(b0))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
                out.append([{"begin": x, "end": y} for x, y in zip(b0.tolist(), e0.tolist())] if texts else None)
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays += [pa.array(kept, pa.binary()), pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return met.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
