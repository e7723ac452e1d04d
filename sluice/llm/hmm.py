"""Language-model scores from a hidden Markov model trained by Baum-Welch.

Tokens are folded words and one end token per text. The model's symbols are the
``SYMBOLS`` most frequent tokens, the end, and ``CLASSES`` classes (a hash of a word's last three
bytes) for all others; a word of a class has P(word | class) = (c + 1/2) / (C + (V + 1) / 2)
from the counts c of all training texts, where C and V are the class's tokens and distinct
words and the remaining unit stands for words not seen. Each symbol has one probability per latent
state, so the scaled forward recursion over symbols, times the class terms, is the exact likelihood of
the text.

Training: word counts over all training texts; starting values from all training texts, dealt to states
by their most frequent symbol; then Baum-Welch rounds in which every partition runs the
scaled forward-backward recursion over its whole texts and the expected counts are summed by
Spark, a row per symbol, until a round gains no more than ``SETTLED`` of the log likelihood. The table of frequent words is bounded by ``KNOWN``; counts of
rarer words are joined, never broadcast.

Defined results: null or empty text is the end token alone; repeated rows train and score
each; a null id counts as trained; an empty training set leaves uniform probabilities; an empty table
gives no rows. Columns other than the id and the text are ignored, whatever their names. A very long text is
one sequence and never cut: a task holds about 60 bytes for each of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import keep, table
from sluice.llm.wordbytes import Words, pieces

STATES = 8
SYMBOLS = 8_192
CLASSES = 512
KNOWN = 131_072
SETTLED = 1e-3
#: Pseudo-counts that smooth emissions towards all texts' symbol frequencies, and moves.
SMOOTH_EMIT, SMOOTH_MOVE = 50.0, 1.0
END = b""
#: Bytes of text that are counted, and coded, at a time, and symbols that one set of steps takes (one text at least).
COUNTED, CODED, AT_ONCE = 8 << 20, 3 << 20, 1_000_000
#: Symbols from which sets of texts of like lengths are made.
GATHERED = 8_000_000


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


@dataclass
class Hmm:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (S, K)


def by_length(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out step by step: (flat symbols, start of each step,
    active sequences of each step, order)."""
    sizes = np.array([len(s) for s in seqs])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max())
    active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
    first = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(int(first[-1]), dtype=np.int64)
    for row, k in enumerate(order):
        flat[first[: sizes[k]] + row] = seqs[k]
    return flat, first, active, order


def forward(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion."""
    flat, first, active, order = by_length(seqs)
    scale = np.empty(len(flat))
    emit, move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    alpha = None
    for t, n in enumerate(active.tolist()):
        a, b = first[t], first[t + 1]
        now = emit.take(flat[a:b], axis=1)
        now *= model.start[:, None] if alpha is None else move @ alpha[:, :n]
        now /= now.sum(axis=0, out=scale[a:b])
        alpha = now
    row = np.concatenate([np.arange(n) for n in active])
    out = np.empty(len(seqs))
    out[order] = np.bincount(row, weights=np.log10(scale), minlength=len(seqs))
    return out


def expected_counts(model: Hmm, seqs: list[np.ndarray], n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log10 likelihood. A row of
    an array is a state, a column a place in a sequence."""
    k = len(model.start)
    flat, first, active, _ = by_length(seqs)
    held = np.empty((k, len(flat)), dtype=np.float32)  # scaled forward values, then posteriors
    scale = np.empty(len(flat), dtype=np.float32)
    emit, move = np.ascontiguousarray(model.emit.T, dtype=np.float32), model.move.astype(np.float32)
    back_move, start = np.ascontiguousarray(move.T), model.start.astype(np.float32)[:, None]
    alpha = None
    for t, n in enumerate(active.tolist()):
        a, b = first[t], first[t + 1]
        now = emit.take(flat[a:b], axis=1)
        now *= start if alpha is None else back_move @ alpha[:, :n]
        now /= now.sum(axis=0, out=scale[a:b])
        held[:, a:b] = alpha = now
    moves = np.zeros((k, k))
    beta = np.ones((k, len(seqs)), dtype=np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        a, b = first[t], first[t + 1]
        now = beta[:, :n]
        held[:, a:b] *= now
        if t:
            back = emit.take(flat[a:b], axis=1)
            back *= now
            back /= scale[a:b]
            moves += held[:, first[t - 1] : first[t - 1] + n] @ back.T
            np.matmul(move, back, out=now)
    moves *= model.move
    emits = np.stack([np.bincount(flat, weights=held[s], minlength=n_symbols) for s in range(k)], axis=1)
    return held[:, : len(seqs)].sum(axis=1, dtype=np.float64), moves, emits, float(np.log10(scale, dtype=np.float64).sum())


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, background: np.ndarray) -> Hmm:
    start = (starts + 1) / (starts + 1).sum()
    move = (moves + SMOOTH_MOVE) / (moves + SMOOTH_MOVE).sum(axis=1, keepdims=True)
    emit = emits + SMOOTH_EMIT * background[:, None]
    return Hmm(start, move, emit / emit.sum(axis=0, keepdims=True))


def seeded(seqs: list[np.ndarray], background: np.ndarray, states: int = STATES, rounds: int = 0) -> Hmm:
    """Starting values of texts dealt to states in turn, and ``rounds`` rounds, all in memory."""
    dealt = np.zeros((len(background), states))
    for k, s in enumerate(seqs):
        dealt[:, k % states] += np.bincount(s, minlength=len(background)) / max(1, len(s))
    model = starting(dealt / max(1, len(seqs) / states), background)
    for _ in range(rounds if seqs else 0):
        model = maximised(*expected_counts(model, seqs, len(background))[:3], background)
    return model


def starting(dealt: np.ndarray, background: np.ndarray, share: float = 0.2) -> Hmm:
    """States that stay, with emissions near all texts' frequencies and ``share`` of those dealt to them."""
    states = dealt.shape[1]
    rng = np.random.default_rng(7)
    emits = background[:, None] * rng.uniform(0.5, 1.5, size=(len(background), states)) + share * dealt
    stay = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
    return Hmm(np.full(states, 1 / states), stay / stay.sum(axis=1, keepdims=True), emits / emits.sum(axis=0, keepdims=True))


def held_out_column(id_col: str = "doc_id", folds: int = 5, fold: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def word_counts(rows: DataFrame) -> DataFrame:
    """word (folded bytes; empty: the end), c of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=COUNTED):
            index, distinct = Words(batch.column("text")).coded()
            n = np.bincount(index, minlength=len(distinct))
            words = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, batch.num_rows))], names=["word", "c"])

    return rows.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """What scoring must know of words: bounded by KNOWN words and CLASSES classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, tokens: int, distinct: int, ends: int = 0):
        self.counts = np.append(counts, 0)  # of KNOWN words; last: not among them
        self.symbols = min(SYMBOLS, len(words))
        self.at = {w: i for i, w in enumerate(words)}
        self.class_log = np.log10(class_tokens + 0.5 * (class_words + 1))
        self.ends = ends  # of the end token, known or not
        self.tokens, self.base_log = tokens, np.log10(tokens + 0.5 * (distinct + 1))

    @property
    def size(self) -> int:
        """Symbols: frequent words, the end (even if never seen), classes."""
        return self.symbols + 1 + CLASSES

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place among known words or -1, symbol) of words."""
        place = np.fromiter((self.at.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        symbol = place.copy()
        for k in np.flatnonzero((place < 0) | (place >= self.symbols)):
            symbol[k] = self.symbols + 1 + class_of(words[k])
        return place, symbol


def encoded(rows: DataFrame, lexicon) -> DataFrame:
    """Each text as symbols, with the part of its sums that known words make and its other words.

    Columns: doc_id, held_out, rid, n_tokens, known, base (sum of log10(c+1/2) of known words),
    inner (log10 P(word | class) of known words, less the denominators of all class words), seq, rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = lexicon.value
        end = lex.at.get(END, -1)
        end_symbol = end if 0 <= end < lex.symbols else lex.symbols
        for batch in pieces(batches, limit=CODED):
            words = Words(batch.column("text"))
            index, distinct = words.coded()
            index = index.astype(np.int64)
            place, symbol = lex.look(distinct.to_pylist())
            c = lex.counts[place]  # -1: 0
            logc = np.where(place >= 0, np.log10(c + 0.5), 0.0)
            in_class = symbol > lex.symbols
            inner = np.where(in_class, logc - lex.class_log[np.where(in_class, symbol - lex.symbols - 1, 0)], 0.0)
            doc, n = words.doc_of(), batch.num_rows
            total = lambda x: np.bincount(doc, weights=x[index], minlength=n) if len(index) else np.zeros(n)
            known = total((place >= 0).astype(float)) + (lex.ends > 0)
            base = total(logc) + np.log10(lex.ends + 0.5)
            unknown = np.flatnonzero(place[index] < 0) if len(index) else np.zeros(0, np.int64)
            key, count = np.unique((doc[unknown] << 32) | index[unknown], return_counts=True)
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(key & 0xFFFFFFFF)).cast(pa.binary()), pa.array(count.astype(np.int64))], names=["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(key >> 32, np.arange(n + 1)).astype(np.int32)), rare)
            #: the end goes behind each text's words
            size = words.counts + 1
            codes = np.empty(int(size.sum()), dtype=np.uint16)
            ends = np.cumsum(size)
            inside = np.ones(len(codes), dtype=bool)
            inside[ends - 1] = False
            codes[inside] = symbol[index]
            codes[ends - 1] = end_symbol
            seq = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total(inner)), seq, rare], names=["doc_id", "held_out", "n_tokens", "known", "base", "inner", "seq", "rare"])

    got = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, seq binary, rare array<struct<word:binary,n:long>>")
    return keep(got.withColumn("rid", F.monotonically_increasing_id()), "encoded")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] // 2
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint16)
    return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


def _batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts of like lengths, so that the steps of a set are few: about AT_ONCE symbols each."""

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held).combine_chunks()
        size = pc.binary_length(part.column("seq")).to_numpy()
        part = part.take(pa.array(np.argsort(-size, kind="stable"))).combine_chunks()
        for batch in part.to_batches():
            yield from pieces(iter([batch]), "seq", 2 * AT_ONCE)

    held, bytes_held = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            bytes_held += pc.sum(pc.binary_length(batch.column("seq"))).as_py()
            if bytes_held >= 2 * GATHERED:
                yield from dealt(held)
                held, bytes_held = [], 0
    if held:
        yield from dealt(held)


def _leading(seq: np.ndarray) -> int:
    """The most frequent symbol of a text, its end aside."""
    return int(np.bincount(seq[:-1]).argmax()) if len(seq) > 1 else int(seq[-1])


def starting_model(texts: DataFrame, size: int, background: np.ndarray, states: int = STATES) -> Hmm:
    """Starting values from all texts. Texts of one most frequent symbol (mostly of one language or
    kind) go to one state; symbols are dealt by their numbers of texts, largest first, to the emptiest state."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in _batches_of(batches):
            for seq in _sequences(batch.column("seq")):
                n[_leading(seq)] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["r", "n"])

    state, load = np.zeros(size, np.int64), np.zeros(states, np.int64)
    for r in sorted(texts.select("seq").mapInArrow(lead, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).collect(), key=lambda r: (-r.n, r.r)):  # a row per symbol
        state[r.r] = load.argmin()
        load[state[r.r]] += r.n
    cols = [f"s{i}" for i in range(states)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((size, states))
        for batch in _batches_of(batches):
            for seq in _sequences(batch.column("seq")):
                symbols, n = np.unique(seq, return_counts=True)
                rows[symbols, state[_leading(seq)]] += n / len(seq)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(rows[used, i].copy()) for i in range(states)]], names=["r", *cols])

    dealt = np.zeros((size, states))
    for r in texts.select("seq").mapInArrow(deal, "r int, " + ", ".join(f"{c} double" for c in cols)).groupBy("r").agg(*[F.sum(c).alias(c) for c in cols]).collect():  # a row per symbol
        dealt[r.r] = [r[c] for c in cols]
    return starting(dealt / np.maximum(1, load), background, 1.0)


def baum_welch_round(texts: DataFrame, model: Hmm, size: int, background: np.ndarray) -> tuple[Hmm, float]:
    """One round over all texts: counts of each partition, summed by symbol; and the log10
    likelihood of the texts before it."""
    k = len(model.start)
    share = texts.sparkSession.sparkContext.broadcast(model)
    cols = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        starts, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), np.zeros((1, k))
        for batch in _batches_of(batches):
            a, b, c, d = expected_counts(m, _sequences(batch.column("seq")), size)
            starts += a
            moves += b
            emits += c
            log[0, 0] += d
        rows = np.concatenate([emits, starts[None, :], moves, log])
        used = np.flatnonzero(rows.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(rows[used, i].copy()) for i in range(k)]], names=["r", *cols])

    summed = texts.select("seq").mapInArrow(run, "r int, " + ", ".join(f"{c} double" for c in cols)).groupBy("r").agg(*[F.sum(c).alias(c) for c in cols])
    rows = np.zeros((size + 2 + k, k))
    for r in summed.collect():  # a row per symbol, state and start, and the likelihood
        rows[r.r] = [r[c] for c in cols]
    return maximised(rows[size], rows[size + 1 : -1], rows[:size], background), float(rows[-1, 0])


def trained(texts: DataFrame, size: int, background: np.ndarray) -> Hmm:
    """Rounds over all texts until the likelihood settles."""
    model, before = starting_model(texts, size, background), None
    while True:
        model, now = baum_welch_round(texts, model, size, background)
        if before is not None and now - before <= SETTLED * abs(before):
            return model
        before = now


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """Words from the smallest count that at most ``most`` words reach. The count is
    found on a histogram of sixteenths of octaves, so nothing is sorted or merged on the driver."""
    octave = F.floor(F.log2("c") * 16)
    steps = sorted(counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.o)  # some thousand rows at most
    total, least = 0, None
    for step in steps:
        total += step.n
        if total > most:
            break
        least = step.least
    return counts.where(F.lit(False) if least is None else F.col("c") >= least)


def hmm_scores(docs: DataFrame, held_out, id_col: str = "doc_id") -> DataFrame:
    """Train on rows where ``held_out`` is false and score all rows of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    counts = keep(word_counts(rows.where(~F.col("held_out"))), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent_words(counts, KNOWN).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    words = [bytes(r.word) for r in top]
    of_top = np.array([r.c for r in top], dtype=np.int64)
    n_sym = min(SYMBOLS, len(words))
    ends = (counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first())[0]
    frequent = spark.createDataFrame([(w,) for w in words[:n_sym]], "word binary")
    suffix = F.when(F.length("word") > 3, F.expr("substring(word, length(word) - 2, 3)")).otherwise(F.col("word"))
    grouped = counts.join(F.broadcast(frequent), "word", "left_anti").where(F.length("word") > 0).groupBy(F.pmod(F.crc32(suffix), F.lit(CLASSES)).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))  # SYMBOLS rows at most
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in grouped.collect():
        class_tokens[r.k], class_words[r.k] = r.c, r.v
    lex = Lexicon(words, of_top, class_tokens, class_words, tokens, distinct, ends)
    background = np.concatenate([of_top[:n_sym], [0 if END in words[:n_sym] else ends], class_tokens]) + 0.5
    background /= background.sum()
    texts = encoded(rows, spark.sparkContext.broadcast(lex))

    training = texts.where("not held_out")
    model = trained(training, lex.size, background)
    share = spark.sparkContext.broadcast(model)

    kept = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches_of(batches):
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(forward(share.value, _sequences(batch.column("seq"))))], names=[*kept, "chain"])

    scored = texts.select(*kept, "seq").mapInArrow(score, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, chain double")
    rare = texts.select("rid", F.explode("rare").alias("x")).select("rid", "x.*").join(counts, "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) * F.col("n")
    sums = rare.groupBy("rid").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = scored.join(sums, "rid", "left").na.fill({"more": 0.0, "seen": 0})
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("seen")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(float(lex.base_log))).alias("base_score"),
        (F.col("chain") + F.col("inner") + F.col("more")).alias("score"),
    )


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"), held_out_column())
