"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers (A, B) cut the same bytes. For a block of texts the bytes of each side's tokens are laid out once and
``np.repeat`` gives, for A and for B, the token that owns each byte. Where both owners change at once both tokens end: a cut, and
the bytes between two cuts are a group. Consecutive distinct owner pairs are the overlaps of tokens. Tokens of one
group are linked, each of A with each of B.

Groups of many tokens are first counted by distinct ids, so a group of a and b tokens costs its distinct ids, not a x b links.

Counts of id pairs (in how many documents a pair is linked) are aggregated over all documents, partially before
their shuffle. At most ``HELD`` pairs, those of the highest counts, are broadcast; all rarer pairs are joined and summed per document,
so nothing is dropped.

Defined results: texts that are null or empty, or whose joined bytes of A or B differ from a space and the text, have no tokens and
zeros; texts are read whole, about 2 MB of texts (or one text) at a time; repeated rows count each; an empty
table gives no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import keep, table
from sluice.llm.wordbytes import pieces, ragged_take, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pairs that are broadcast at most (24 MB), and links of a group that are laid out one by one at most.
HELD = 1 << 20
SMALL = 64
SHIFT = 32


class Bytes:
    """The bytes of tokens by id, and their decimal numbers."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        numbers = [b"%d," % i for i in range(len(tokens))]
        self.number_size = np.array([len(t) for t in numbers], dtype=np.int64)
        self.number_start = np.cumsum(self.number_size) - self.number_size
        self.numbers = np.frombuffer(b"".join(numbers), dtype=np.uint8)


class ByteLevel:
    """A: a byte-level BPE file; special strings are plain text."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from sluice.llm.bpe import ByteBpe

        self.coder = ByteBpe(json_path, ranks_path)
        self.coder.library.encode_special_tokens = True
        self.coder.special = []
        #: bytes that print stand for themselves, the others for the code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        library = self.coder.library
        named = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
        self.tokens = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in named]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return self.coder.encode(texts)


class Pieces:
    """B: a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        self.tokens = [bytes([int(self.coder.id_to_piece(i)[3:-1], 16)]) if self.coder.is_byte(i) else self.coder.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, dtype=np.int64) for ids in self.coder.encode(texts, num_threads=1)]


def _spelt(side: Bytes, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens, first byte of each text and the end)."""
    flat, at = ragged_take(side.flat, side.start, side.size, ids)
    return flat, at[first]


def _same(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray) -> np.ndarray:
    """Whether the strings at each place are equal."""
    out = np.diff(left_at) == np.diff(right_at)
    if len(left) == len(right) and out.all() and np.array_equal(left, right):
        return out
    for d in np.flatnonzero(out):
        out[d] = np.array_equal(left[left_at[d] : left_at[d + 1]], right[right_at[d] : right_at[d + 1]])
    return out


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of each i, one after another."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return at + np.arange(len(at))


def owners(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of two sides over the same bytes: (first A, first B) of all overlaps, one after another, and the group of each
    A and of each B token."""
    own_a, own_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    turn_a, turn_b = np.diff(own_a) != 0, np.diff(own_b) != 0
    place = np.concatenate([[True], turn_a | turn_b]) if len(own_a) else np.zeros(0, dtype=bool)
    pair_a, pair_b = own_a[place], own_b[place]
    cut = np.concatenate([[True], turn_a & turn_b]) if len(own_a) else np.zeros(0, dtype=bool)
    group = np.cumsum(cut) - 1
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    return pair_a, pair_b, group[first_a], group[first_b]


def _pairs(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, and how often."""
    key, n = np.unique(group << SHIFT | ids, return_counts=True)
    return key >> SHIFT, key & ((1 << SHIFT) - 1), n


def linked(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair as one number, links) of all linked tokens; doc_of: the text of each group."""
    n_groups = len(doc_of)
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    large = n_a * n_b > SMALL
    parts = []
    for some in (~large, large):
        if not some.any():
            continue
        in_a, in_b = some[group_a], some[group_b]
        ga, ia, gb, ib = group_a[in_a], ids_a[in_a], group_b[in_b], ids_b[in_b]
        ca, cb = np.ones(len(ga), dtype=np.int64), np.ones(len(gb), dtype=np.int64)
        if some is large:
            (ga, ia, ca), (gb, ib, cb) = _pairs(ia, ga), _pairs(ib, gb)
        #: every A row meets the B rows of its group, which lie together
        size_b = np.bincount(gb, minlength=n_groups)
        start_b = np.cumsum(size_b) - size_b
        meets = size_b[ga]
        a_row, b_row = np.repeat(np.arange(len(ga)), meets), _each(start_b[ga], meets)
        parts.append((doc_of[ga[a_row]], ia[a_row] << SHIFT | ib[b_row], ca[a_row] * cb[b_row]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, pair, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pair) != 0)])
    return doc[new], pair[new], np.add.reduceat(n, np.flatnonzero(new))


def _spelt_groups(a: Bytes, ids_a: np.ndarray, group_a: np.ndarray, b: Bytes, ids_b: np.ndarray, group_b: np.ndarray, doc_of: np.ndarray, texts: int) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    group = np.concatenate([group_a, group_b])
    order = np.argsort(group * 2 + np.repeat([0, 1], [len(ids_a), len(ids_b)]), kind="stable")
    side = order >= len(ids_a)
    sizes = np.concatenate([a.number_size[ids_a], b.number_size[ids_b]])
    starts = np.concatenate([a.number_start[ids_a], b.number_start[ids_b] + len(a.numbers)])
    flat, at = ragged_take(np.concatenate([a.numbers, b.numbers]), starts, sizes, order)
    last = at[1:] - 1
    next_group = np.append(group[order][1:], -1) != group[order]
    turn = np.append(side[1:], False) != side
    flat[last[turn & ~next_group]] = ord("|")
    flat[last[next_group]] = ord(";")
    #: places of each text's first byte
    doc = doc_of[group[order]]
    edge = at[np.searchsorted(doc, np.arange(texts + 1))]
    out = flat.tobytes()
    return [hashlib.sha256(out[edge[d] : edge[d + 1] - 1]).hexdigest() if edge[d + 1] > edge[d] else "" for d in range(texts)]


def aligned(docs: DataFrame, tokenizer_a: tuple[str, str | None], tokenizer_b: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, pairs, links) of every row; pairs: the distinct id
    pairs (A's id << 32 | B's id) of its links, links: how many of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteLevel(*tokenizer_a), Pieces(tokenizer_b)
        a, b = Bytes(left.tokens), Bytes(right.tokens)
        for batch in pieces(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
            n = len(texts)
            ids_a, ids_b = left.encode(spaced), right.encode(texts.to_pylist())
            first_a = np.concatenate([[0], np.cumsum([len(x) for x in ids_a])]).astype(np.int64)
            first_b = np.concatenate([[0], np.cumsum([len(x) for x in ids_b])]).astype(np.int64)
            flat_a, flat_b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
            want, want_at = text_bytes(spaced)
            fine = _same(*_spelt(a, flat_a, first_a), want, want_at) & _same(*_spelt(b, flat_b, first_b), want, want_at) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
            n_a, n_b = np.where(fine, np.diff(first_a), 0), np.where(fine, np.diff(first_b), 0)
            flat_a, flat_b = flat_a[np.repeat(fine, np.diff(first_a))], flat_b[np.repeat(fine, np.diff(first_b))]
            doc_a = np.repeat(np.arange(n), n_a)
            pair_a, _, group_a, group_b = owners(a.size[flat_a], b.size[flat_b])
            n_groups_all = int(group_a[-1]) + 1 if len(group_a) else 0
            doc_of = np.zeros(n_groups_all, dtype=np.int64)
            doc_of[group_a] = doc_a
            doc, pair, links = linked(flat_a, group_a, flat_b, group_b, doc_of)
            edge = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            of_doc = lambda x: pa.array(np.bincount(x, minlength=n).astype(np.int64))
            total = np.concatenate([[0], np.cumsum(links)])[edge.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n_a.astype(np.int64)),
                    pa.array(n_b.astype(np.int64)),
                    of_doc(doc_of),
                    of_doc(doc_a[pair_a]),
                    pa.array(np.diff(total)),
                    pa.array(_spelt_groups(a, flat_a, group_a, b, flat_b, group_b, doc_of, n), pa.string()),
                    pa.ListArray.from_arrays(edge, pa.array(pair)),
                    pa.ListArray.from_arrays(edge, pa.array(links)),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256", "pairs", "links"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    return rows.mapInArrow(run, kinds)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked, and whether no other pair of its A id is in more."""
    counts = keep(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    a_id = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # a row per id of A's vocabulary
    return counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def scores(rows: DataFrame, counts: DataFrame, held: int = HELD) -> DataFrame:
    """``rows`` with n_best and count_sum in place of pairs and links."""
    spark = rows.sparkSession
    floor, total = 64, 0
    for power, n in sorted(counts.groupBy(_class(F.col("n")).alias("power")).count().collect(), reverse=True):  # 64 rows at most
        total += n
        if total > held:
            break
        floor = power
    got = counts.where(_class(F.col("n")) >= floor).toArrow()  # ``held`` rows at most
    order = np.argsort(got.column("pair").to_numpy())
    share = spark.sparkContext.broadcast((got.column("pair").to_numpy()[order], got.column("n").to_numpy()[order], got.column("best").to_numpy(zero_copy_only=False)[order]))

    def look(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = share.value[0]
        at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        return at, (known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool))

    def lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = batch.column("pairs")
        return pairs.flatten().to_numpy(), batch.column("links").flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, count, best = share.value
        for batch in batches:
            pairs, links, edge = lists(batch)
            at, there = look(pairs)
            each = [np.where(there, x[at] * links if len(x) else 0, 0) for x in (best.astype(np.int64), count)]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[edge]).astype(np.int64) for x in each]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)], names=[*batch.schema.names[:-2], "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, links, edge = lists(batch)
            out = ~look(pairs)[1]
            row = np.repeat(batch.column("row").to_numpy(), np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(pairs[out]), pa.array(links[out])], names=["row", "pair", "links"])

    names = [c for c in rows.columns if c not in ("pairs", "links")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    base = rows.select(*names, "pairs", "links").mapInArrow(score, f"{kinds}, n_best long, count_sum long")
    if total <= held:
        return base
    rare = counts.where(_class(F.col("n")) < floor)
    left = rows.select("row", "pairs", "links").mapInArrow(rest, "row long, pair long, links long")
    more = left.join(rare, "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("b"), F.sum(F.col("links") * F.col("n")).alias("c"))
    joined = base.join(more, "row", "left")
    return joined.select(*names, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"))


def alignment(docs: DataFrame, tokenizer_a: tuple[str, str | None], tokenizer_b: str, id_col: str = "doc_id", held: int = HELD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, n_best, count_sum) of every row of ``docs`` (its id, text)."""
    rows = keep(aligned(docs, tokenizer_a, tokenizer_b, id_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    return scores(rows.select("row", *[c for c in rows.columns if c != "row"]), pair_counts(rows), held).drop("row")


def default_tokenizers() -> tuple[tuple[str, str], str]:
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment(table(spark, sf_dir, "documents"), *default_tokenizers())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
