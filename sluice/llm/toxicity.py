"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of four-letter word beginnings (letters only,
folded). The model shares one weight vector across ordered thresholds,
P(grade <= j) = sigmoid(theta_j - w.x), and gives the expected grade as severity.

Training uses about ``SAMPLE`` labelled rows at most (a parameter; a share of the ids' hashes); features are chosen from counts over that sample,
in which equal feature sets (copies) count once. The order of grades is that of abuse: 0 is labelled clean, 1 is labelled toxic with few
cue words, 2 with more of them than the median toxic row has. Cue words are words that are ``CUE_RATIO`` times as frequent in rows labelled
toxic as in clean ones. Where all toxic rows have as many there are two grades.

The cut from which a document is rejected is fitted, too: two models, each trained on one half of the sample, judge the other half, and
the cut with the best F1 there is taken. Scoring reads
every whole text, about 2 MB of texts (or one text) at a time.

Defined results: null or empty text gets the score of no features; ids without a
document, rows with null labels and ids with labels that differ don't train; with labels of one class
only every document gets grade 0 and severity 0 if that class is clean, else 1; repeated rows are
scored each; an empty table gives no rows; extra columns are ignored by ``grade`` and kept by ``drop_toxic``,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import keep, table
from sluice.llm.wordbytes import Words, pieces

SAMPLE = 20_000
FEATURES = 4_096
#: A feature is kept if it occurs in so many sampled rows.
LEAST_ROWS = 6
#: ... and leans to one class by so many standard deviations; others are noise to the fit. Few labels
#: cannot reach that, so half of the largest deviation found is enough, too.
LEAST_Z = 5.0
STEPS = 400
RIDGE = 5e-4
#: P(grade >= 1) from which a document is rejected where halves of the labels hold fewer than ``LEAST_JUDGED`` rows of a class.
REJECT = 0.5
LEAST_JUDGED = 5
CUE_RATIO = 8
PREFIX = 4

_TRIM = re.compile(rb"^[^a-z\x80-\xff]+|[^a-z\x80-\xff]+$")


def features_of(word: bytes) -> list[bytes]:
    """The features a folded word stands for."""
    word = _TRIM.sub(b"", word)
    if not word:
        return []
    text = word.decode("utf-8", "replace").lower()
    return [text.encode(), b"^" + text[:PREFIX].encode()] if len(text) > PREFIX else [text.encode()]


def document_features(texts: pa.Array, known: dict[bytes, int] | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document, feature) pairs without repeats, and the features' names. With ``known``
    only its features are looked at and numbers are its values."""
    words = Words(texts)
    index, distinct = words.encode()
    names: dict[bytes, int] = {} if known is None else known
    one = np.full(len(distinct), -1, dtype=np.int64)
    two = np.full(len(distinct), -1, dtype=np.int64)
    for k, w in enumerate(distinct):
        for slot, f in zip((one, two), features_of(w)):
            slot[k] = names.setdefault(f, len(names)) if known is None else names.get(f, -1)
    doc = words.doc_of()
    pairs = np.concatenate([(doc << 32) | one[index], (doc << 32) | two[index]]) if len(index) else np.zeros(0, np.int64)
    pairs = np.unique(pairs[np.concatenate([one[index], two[index]]) >= 0]) if len(index) else pairs
    return pairs >> 32, pairs & 0xFFFFFFFF, list(names) if known is None else []


@dataclass
class OrdinalModel:
    """Shared weights and ascending thresholds of a cumulative-link model."""

    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = REJECT
    #: on rows that did not train: precision, recall and F1 at the cut, and for each grade j the mean P(grade >= j) and its true share
    held_out: dict[str, float] = field(default_factory=dict)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1.."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def severity(self, score: np.ndarray) -> np.ndarray:
        return self.probabilities(score).sum(axis=1)


def thresholds_of(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """A first threshold plus positive gaps, so they stay in order."""
    return np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def loss_and_gradients(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, params: list[np.ndarray], ridge: float) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood with its penalty, and gradients by weights, first threshold and log gaps."""
    w, first, gaps = params
    n, levels = len(grades), len(gaps) + 1
    theta = thresholds_of(first, gaps)
    score = np.bincount(rows, weights=w[cols], minlength=n)
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = edges[grades + 1] - score, edges[grades] - score
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    up, down = np.where(np.isinf(hi), 1, sigmoid(hi)), np.where(np.isinf(lo), 0, sigmoid(lo))
    p = np.maximum(up - down, 1e-9)
    d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
    d_score = (d_up - d_down) / n
    d_theta = np.zeros(levels)
    np.add.at(d_theta, np.minimum(grades, levels - 1), np.where(grades < levels, -d_up, 0) / n)
    np.add.at(d_theta, np.maximum(grades - 1, 0), np.where(grades > 0, d_down, 0) / n)
    tail = np.cumsum(d_theta[::-1])[::-1]
    loss = float(-np.log(p).mean() + 0.5 * ridge * (w @ w))
    return loss, [np.bincount(cols, weights=d_score[rows], minlength=len(w)) + ridge * w, np.array([tail[0]]), tail[1:] * np.exp(gaps)]


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, steps: int = STEPS, ridge: float = RIDGE, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum penalised likelihood (Adam, full batch)."""
    levels = int(grades.max())
    above = np.array([(grades >= j).mean() for j in range(1, levels + 1)])
    base = np.log((1 - above) / above)
    params = [np.zeros(n_features), base[:1].copy(), np.log(np.maximum(np.diff(base), 1e-2))]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, steps + 1):
        _, grads = loss_and_gradients(rows, cols, grades, params, ridge)
        for p_, g, m in zip(params, grads, moment):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            p_ -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return params[0], thresholds_of(*params[1:])


def labelled_grades(labels: DataFrame) -> DataFrame:
    """_id, _grade (0 clean, 1 toxic) of every id whose labels agree."""
    toxic = F.col("toxic").cast("int")
    grade = F.when(toxic.isin(0, 1), toxic)
    rows = labels.select(F.col("doc_id").alias("_id"), grade.cast("int").alias("_grade")).where("_id is not null and _grade is not null")
    return rows.groupBy("_id").agg(F.min("_grade").alias("_grade"), F.max("_grade").alias("_most")).where("_grade = _most").drop("_most")


def by_abuse(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Grades 0, 1, 2 by how many different cue words a toxic row holds."""
    held = np.bincount(cols, minlength=len(names)).astype(np.float64)
    bad = np.bincount(cols, weights=toxic[rows], minlength=len(names))
    word = np.array([not n.startswith(b"^") for n in names], dtype=bool)
    cue = word & (bad * (len(toxic) - toxic.sum()) >= CUE_RATIO * (held - bad) * toxic.sum())
    n = np.bincount(rows, weights=cue[cols], minlength=len(toxic))
    middle = np.median(n[toxic == 1]) if toxic.any() else 0.0
    return np.where(toxic == 1, 1 + (n > middle), 0).astype(np.int64)


def _dense(grades: np.ndarray) -> np.ndarray:
    """Grades that no row has are left out: 0 and 2 become 0 and 1."""
    return np.unique(grades, return_inverse=True)[1].astype(np.int64)


def best_cut(p: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float, float]:
    """(cut, precision, recall, F1) of the best F1 over cuts of 0.05, 0.1, ..; of equal ones the middle."""
    cuts = np.arange(1, 20) / 20
    hit = np.array([((p >= c) & (toxic == 1)).sum() for c in cuts], dtype=np.float64)
    said = np.array([(p >= c).sum() for c in cuts], dtype=np.float64)
    f1 = 2 * hit / np.maximum(said + toxic.sum(), 1)
    at = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(at[len(at) // 2])
    return float(cuts[k]), float(hit[k] / max(said[k], 1)), float(hit[k] / max(toxic.sum(), 1)), float(f1[k])


def judged(ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[float, dict[str, float]]:
    """(cut, report) from two models that judge the rows the other was trained on; halves go by a hash of the id."""
    half = np.array([zlib.crc32(str(i).encode()) & 1 for i in ids.tolist()], dtype=np.int64)
    toxic = (grades > 0).astype(np.int64)
    levels = int(grades.max())
    if min(np.bincount(half[toxic == k], minlength=2).min() for k in (0, 1)) < LEAST_JUDGED or any(len(np.unique(grades[half == h])) <= levels for h in (0, 1)):
        return REJECT, {}
    p = np.zeros((len(grades), levels))
    for h in (0, 1):
        mine = half == h
        place = np.cumsum(mine) - 1
        inside = mine[rows]
        w, theta = fit_ordinal(place[rows[inside]], cols[inside], grades[mine], n_features)
        score = np.bincount(rows, weights=w[cols], minlength=len(grades))
        p[~mine] = OrdinalModel({}, w, theta).probabilities(score)[~mine]
    cut, precision, recall, f1 = best_cut(p[:, 0], toxic)
    report = {"rows": len(grades), "precision": precision, "recall": recall, "f1": f1}
    for j in range(levels):
        report |= {f"expected_{j + 1}": float(p[:, j].mean()), f"share_{j + 1}": float((grades > j).mean())}
    severity = p.sum(axis=1)
    low, high = severity[grades == 1], np.sort(severity[grades == 2]) if levels == 2 else np.zeros(0)
    if len(low) and len(high):  # the share of pairs of a milder and a worse row in which the worse one has the higher severity
        report["ordered"] = float((len(high) - np.searchsorted(high, low, side="right")).sum() / (len(low) * len(high)))
    return cut, report


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> OrdinalModel:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    chosen = labelled_grades(labels)
    n = chosen.count()
    if n > sample:
        chosen = chosen.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    chosen = keep(chosen, "sample")
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # about `sample` rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            doc, feature, names = document_features(batch.column("text"), None)
            lists = np.split(feature, np.searchsorted(doc, np.arange(1, batch.num_rows)))
            array = np.array(names, dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_grade"), pa.array([sorted(array[x].tolist()) for x in lists], pa.list_(pa.binary()))], names=["doc_id", "grade", "features"])

    rows = keep(met.select("doc_id", "_grade", "text").mapInArrow(read, "doc_id long, grade int, features array<binary>").groupBy("features").agg(F.min("doc_id").alias("doc_id"), F.max("grade").alias("grade")), "features")
    toxic = (F.col("grade") > 0).cast("int")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(toxic), F.lit(0))).first()
    if bad in (0, n):
        return OrdinalModel({}, np.zeros(0), np.array([60.0 if not bad else -60.0]))
    counts = rows.select(toxic.alias("toxic"), F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("a"), F.sum("toxic").alias("t")).where(F.col("a") >= LEAST_ROWS)
    share_bad = bad / n
    z = F.abs(F.col("t") - F.col("a") * share_bad) / F.sqrt(F.col("a") * share_bad * (1 - share_bad))
    ranked = counts.withColumn("z", z)
    bar = min(LEAST_Z, (ranked.agg(F.max("z")).first()[0] or 0.0) / 2)
    kept = ranked.where((F.col("z") >= bar) & (F.col("z") > 1e-9)).orderBy(F.desc("z"), "f").limit(n_features).select("f").collect()
    if not kept:  # nothing tells documents apart, so none is rejected
        return OrdinalModel({}, np.zeros(0), np.array([60.0]))
    known = {bytes(r.f): i for i, r in enumerate(kept)}
    share = rows.sparkSession.sparkContext.broadcast(known)

    def only_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = share.value
        for batch in batches:
            got = [[names[f] for f in fs if f in names] for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "grade", "f"])

    data = rows.mapInArrow(only_known, "doc_id long, grade int, f array<int>").orderBy("doc_id").toPandas()  # sample x features at most
    sizes = data.f.map(len).to_numpy()
    at = np.repeat(np.arange(len(data)), sizes)
    cols = np.concatenate(data.f.to_numpy()) if sizes.sum() else np.zeros(0, np.int64)
    cols = cols.astype(np.int64)
    names = [bytes(r.f) for r in kept]
    grades = _dense(by_abuse(at, cols, (data.grade.to_numpy() > 0).astype(np.int64), names))
    cut, report = judged(data.doc_id.to_numpy(), at, cols, grades, len(kept))
    w, theta = fit_ordinal(at, cols, grades, len(kept))
    return OrdinalModel(known, w, theta, cut, report)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", reject: float | None = None) -> DataFrame:
    """doc_id, grade, severity (expected grade), p_toxic, rejected (from the model's cut on, or ``reject``) of every row."""
    reject = model.cut if reject is None else reject
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in pieces(batches):
            doc, feature, _ = document_features(batch.column("text"), m.features)
            score = np.bincount(doc, weights=m.weights[feature], minlength=batch.num_rows)
            p = m.probabilities(score)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array(p[:, 0] >= reject)], names=["doc_id", "grade", "severity", "p_toxic", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, grade int, severity double, p_toxic double, rejected boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float | None = None) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    reject = model.cut if reject is None else reject
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in pieces(batches, at):
            doc, feature, _ = document_features(batch.column(at), m.features)
            score = np.bincount(doc, weights=m.weights[feature], minlength=batch.num_rows)
            yield batch.filter(pa.array(m.probabilities(score)[:, 0] < reject))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, train(docs, table(spark, sf_dir, "labels")))
