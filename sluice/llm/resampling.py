"""Importance resampling toward a target set, with features from word-id suffix arrays.

Every partition is read in blocks of about 4 MB of text (one text at least). A block's words become ids, its suffix array
orders all word positions by the ids that follow within the same text (to depth ``LONGEST``, as no feature is longer), and the common prefixes of
neighbours give the runs: for each n, a maximal run of positions that share n words is one repeated n-gram. Each run is hashed once
and its bucket is scattered back to the positions of its occurrences.

The CRC-32 of an n-gram comes from those of its parts: appending k bytes is a linear map of the earlier sum over GF(2), so
the sum of "a b" is that of "a" moved by the length of " b", xor that of " b". Tables of these maps are kept per length.

A bucket's gain compares its share in the target with its share in the documents; a document's weight is the
sum of gains over its features; the draw adds a Gumbel term from a hash of the id, so the highest scores are a sample without
replacement. Ranks come from ranges of the score and counts per range, not from one sorted task.

What is broadcast: one number per bucket. What is shuffled: a count per task and bucket, and one short row per document.

Defined results: a null text has no words; texts are read whole, whatever their length; repeated rows are scored each, and of rows
that share an id and a score each may be drawn; a null id draws by the text ``42:null`` and comes after others in ties;
with fewer than 20 documents of enough words none is drawn; an empty table gives no rows, an empty target gives every bucket the gain of its
absence; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import table
from sluice.llm.wordbytes import pieces, text_bytes
from sluice.operators.identity import with_row_index

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK_BYTES = 4 << 20

#: Bytes of words after A-Z are lowered: digits, a-z and all of other scripts; 0 elsewhere.
_WORD = np.arange(256, dtype=np.uint8)
_WORD[65:91] += 32
_WORD[:48] = _WORD[58:65] = _WORD[91:97] = _WORD[123:128] = 0


def _moved(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of single bits, applied to each of x."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), columns[i], np.uint32(0))
    return out


def _one_byte() -> np.ndarray:
    """What appending a zero byte does to each bit of a sum."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


class Appending:
    """Tables by length: what appending so many bytes does to a CRC-32."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}
        self.byte = _one_byte()

    def table(self, size: int) -> np.ndarray:
        if size not in self.tables:
            if len(self.tables) > 4096:
                self.tables.clear()
            out, power, rest = np.uint32(1) << np.arange(32, dtype=np.uint32), self.byte, size
            while rest:
                if rest & 1:
                    out = _moved(power, out)
                power, rest = _moved(power, power), rest >> 1
            each = np.arange(256, dtype=np.uint32)
            self.tables[size] = np.stack([_moved(out, each << np.uint32(8 * k)) for k in range(4)])
        return self.tables[size]

    def joined(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of left + right strings; size: bytes of the right ones."""
        lengths, which = np.unique(size, return_inverse=True)
        if not len(lengths):
            return left
        maps = np.stack([self.table(int(n)) for n in lengths])
        out = right.copy()
        for k in range(4):
            out ^= maps[which, k, left >> np.uint32(8 * k) & np.uint32(255)]
        return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(id of each word, the words by id, first word of each text and the end)."""
    raw, offsets = text_bytes(texts)
    data = _WORD[raw]
    word = data != 0
    edge = np.zeros(len(word) + 1, dtype=bool)
    edge[offsets] = True  # a word ends where its text ends
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[word])])
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, offsets)


def suffix_order(ids: np.ndarray, first: np.ndarray, depth: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in the order of the ids from there on, common ids with the position before in that order, ids left in each
    position's text); both to ``depth``. first: the first position of each text and the end."""
    n = len(ids)
    left = np.minimum(np.repeat(first[1:], np.diff(first)) - np.arange(n), depth)
    keys = [ids]
    for k in range(1, depth):
        nth = np.full(n, -1, dtype=np.int64)  # a text's end comes before all ids
        nth[:-k] = np.where(left[:-k] > k, ids[k:], -1)
        keys.append(nth)
    bits = (int(ids.max()) + 2).bit_length() if n else 1
    if bits * depth < 63:
        packed = np.zeros(n, dtype=np.int64)
        for key in keys:
            packed = packed << bits | key + 1
        order = np.argsort(packed)
    else:
        order = np.lexsort(keys[::-1])
    common = np.zeros(n, dtype=np.int64)
    same = np.ones(max(n - 1, 0), dtype=bool)
    for key in keys:
        sorted_ = key[order]
        same &= (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] >= 0)
        common[1:] += same
    return order, common, left


class Features:
    """Buckets of all runs of 1 to LONGEST words."""

    def __init__(self, buckets: int):
        self.buckets, self.appending = buckets, Appending()

    def block(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each n, (position, bucket) of every n-gram; and the first position of each text and the end."""
        ids, words, first = words_of(texts)
        order, common, left = suffix_order(ids, first)
        alone = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        after = np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32)
        size = np.array([len(w) + 1 for w in words], dtype=np.int64)
        out = []
        for n in range(1, LONGEST + 1):
            whole = left[order] >= n
            #: of neighbours that are no n-grams of their own, the least common prefix counts, and it is below n
            new = (common < n)[whole]
            at = order[whole]
            head = at[new]  # one position of every run
            crc = alone[ids[head]] if len(head) else np.zeros(0, dtype=np.uint32)
            for k in range(1, n):
                w = ids[head + k]
                crc = self.appending.joined(crc, after[w], size[w])
            bucket = (crc % np.uint32(self.buckets)).astype(np.int64)
            out.append((at, bucket[np.cumsum(new) - 1] if len(at) else bucket))
        return out, first


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in pieces(batches, limit=BLOCK_BYTES):
            for _, bucket in features.block(batch.column("text"))[0]:
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    n, all_s, all_t = len(documents), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(documents.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """The draw of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    share = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(len(share.value)), share.value
        for batch in pieces(batches, limit=BLOCK_BYTES):
            grams, first = features.block(batch.column("text"))
            at_word = np.zeros(first[-1], dtype=np.int64)
            for at, bucket in grams:
                at_word[at] += gain[bucket]
            run_ = np.concatenate([[0], np.cumsum(at_word)])
            weight, n_words = run_[first[1:]] - run_[first[:-1]], np.diff(first)
            n_features = sum(np.maximum(n_words - k, 0) for k in range(LONGEST))
            score = weight + np.array([gumbel(d, seed) for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight, score)]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank from 1 for drawn rows."""
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, text_col))
    rows = scored(docs, gain, seed, id_col, text_col).withColumn("_short", F.col("n_words") < min_words).withColumn("_worst", -F.col("score")).withColumn("_null", F.col("doc_id").isNull())
    placed = with_row_index(rows, ["_short", "_worst", "_null", "doc_id"], "_place")
    drawn = placed.where("not _short").count() * percent // 100
    rank = F.when(~F.col("_short") & (F.col("_place") < drawn), F.col("_place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
