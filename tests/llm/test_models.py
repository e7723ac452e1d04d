"""Language-model scores, toxicity and nearest neighbours."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.llm import ann, hmm, toxicity


def brute_forward(model, seq):
    alpha, total = model.start * model.emit[seq[0]], 0.0
    for s in seq[1:]:
        total += math.log10(alpha.sum())
        alpha = (alpha / alpha.sum()) @ model.move * model.emit[s]
    return total + math.log10(alpha.sum())


def small_model(k=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda *s: (x := rng.uniform(0.1, 1, s)) / x.sum(axis=-1, keepdims=True)
    return hmm.Hmm(draw(k), draw(k, k), draw(k, symbols).T.copy())


def test_forward_equals_one_by_one():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n) for n in (1, 7, 3, 7, 40)]
    model = small_model()
    assert np.allclose(hmm.forward(model, seqs), [brute_forward(model, s) for s in seqs])


def test_expected_counts_equal_enumeration():
    import itertools

    model, seq = small_model(2, 3), np.array([0, 2, 1])
    starts, moves, emits, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for path in itertools.product(range(2), repeat=3):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for s, state in zip(seq, path):
            emits[s, state] += p
    got = hmm.expected_counts(model, [seq], 3)
    assert np.allclose(got[0], starts / total, atol=1e-5) and np.allclose(got[1], moves / total, atol=1e-5) and np.allclose(got[2], emits / total, atol=1e-5)
    assert math.isclose(got[3], math.log10(total), rel_tol=1e-6)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [np.repeat(rng.integers(0, 2) * 3, 8) + rng.integers(0, 3, 8) for _ in range(60)]
    model, flat = hmm.seeded(seqs, np.full(6, 1 / 6), states=2, rounds=0), np.full(6, 1 / 6)
    before = hmm.expected_counts(model, seqs, 6)[3]
    for _ in range(8):
        model = hmm.maximised(*hmm.expected_counts(model, seqs, 6)[:3], flat)
    assert hmm.expected_counts(model, seqs, 6)[3] > before


def test_starting_values_hold_every_text(spark):
    """Four of 4,000 texts have symbols of their own: these lean to the state the texts were dealt to."""
    rng = np.random.default_rng(8)
    seqs = [np.append(rng.integers(0, 5, 12) + (50 if i % 1000 == 7 else 5 * (i % 10)), 60) for i in range(4000)]
    texts = spark.createDataFrame([(s.astype(np.uint16).tobytes(),) for s in seqs], "seq binary")
    background = np.bincount(np.concatenate(seqs), minlength=61) + 0.5
    model = hmm.starting_model(texts, 61, background / background.sum())
    assert (model.emit[50:55].max(axis=1) > 2.5 * model.emit[50:55].min(axis=1)).all()


def test_rounds_go_on_until_the_likelihood_settles(spark):
    rng = np.random.default_rng(6)
    seqs = [np.append(rng.integers(0, 4, 12) + 4 * (i % 3), 12) for i in range(300)]
    texts = spark.createDataFrame([(s.astype(np.uint16).tobytes(),) for s in seqs], "seq binary")
    model, flat = hmm.trained(texts, 13, np.full(13, 1 / 13)), np.full(13, 1 / 13)
    a, b, c, before = hmm.expected_counts(model, seqs, 13)
    after = hmm.expected_counts(hmm.maximised(a, b, c, flat), seqs, 13)[3]
    assert after - before <= 2 * hmm.SETTLED * abs(before)


def tokens_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [b""]


def test_scores_query(spark, sf, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 300)
    monkeypatch.setattr(hmm, "SYMBOLS", 100)
    got = hmm.op2_hmm_scoring(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs.doc_id}
    counts = Counter()
    for i, t in zip(docs.doc_id, docs.text):
        if not held[i]:
            counts.update(tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in zip(docs.doc_id, docs.text):
        tokens, r = tokens_of(t), got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(x in counts for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_scores_of_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * (1 + i % 3), 1) for i in range(30)] + [(100, None, 1), (101, "", 1), (None, "the dog", 1), (3, "the cat", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = hmm.hmm_scores(df, hmm.held_out_column()).toPandas()
    assert len(got) == len(rows) and np.isfinite(got.score).all() and np.isfinite(got.base_score).all()
    assert set(got[got.doc_id.isin([100, 101])].n_tokens) == {1} and not got[got.doc_id.isna()].held_out.iloc[0]
    assert hmm.hmm_scores(df.limit(0), hmm.held_out_column()).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over all symbols, a class's words and its unseen word the model gives one."""
    lex = hmm.Lexicon([b"a", b"b"], np.array([5, 3]), np.r_[np.full(hmm.CLASSES, 7.0)], np.r_[np.full(hmm.CLASSES, 2.0)], 100, 50)
    within = [10 ** (math.log10(c + 0.5) - lex.class_log[0]) for c in (4, 3, 0)]
    assert math.isclose(sum(within), 1.0)


def labelled(n=400, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(["vile", "rotten", "filthy", "wretch"], 1 + i // 6 % 4):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic), 3))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (9000, None, "x"), (9001, "", "x"), (None, "vile rotten filthy", "x"), (0, rows[0][1], "x")], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([r for r in labels if r[0] % 5], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, marks)
    got = toxicity.grade(docs, model).toPandas()
    truth = {i: t for i, t, _ in labels}
    held = got[got.doc_id.isin([i for i in truth if i % 5 == 0])]
    assert (held.rejected == held.doc_id.map(truth).astype(bool)).mean() > 0.95
    assert got[got.doc_id.isna()].rejected.all() and not got[got.doc_id >= 9000].rejected.any()
    assert (got.severity >= 0).all() and (got.grade <= 2).all() and (np.diff(model.thresholds) > 0).all()
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == (~got.rejected).sum()


def test_toxicity_with_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    clean = toxicity.grade(docs, toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))).first()
    assert clean.grade == 0 and not clean.rejected
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert not toxicity.grade(docs, toxicity.train(docs, empty)).first().rejected
    assert toxicity.grade(docs.limit(0), toxicity.train(docs, empty)).count() == 0


def test_ordinal_fit_separates_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 3))
    grades = np.clip(x @ np.array([0, 1, 1]), 0, 2)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, cols, grades, 3)
    score = x @ w
    assert ((score[:, None] > theta).sum(axis=1) == grades).mean() > 0.99 and abs(w[0]) < abs(w[1])


def brute_nearest(rows, k=10):
    used = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    out = {}
    for i, v in used:
        if i % 100 == 0:
            near = sorted((math.sqrt(((w - v) ** 2).sum()), j) for j, w in used if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(250)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, rows[0][1]), (500, None), (600, [0.0] * 8), (700, [float("nan")] * 8), (701, [None] * 8), (702, []), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows], "vec_id long, embedding array<double>, bucket int, dist double")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, probes=1000).toPandas()
    want = brute_nearest(rows)
    for i, near in want.items():
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1))
        if i in (0, 300, 400, 800):
            assert mine.vec_id.tolist() == [j for _, j in near][: len(mine)] and len(mine) == len(near)
    hits = sum(len(set(got[got.query_id == i].vec_id) & {j for _, j in near}) for i, near in want.items())
    assert hits >= 0.9 * sum(len(near) for near in want.values())
    assert not set(got.query_id) & {500, 600, 700}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    one = ann.nearest(df, F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    monkeypatch.setattr(ann, "SPLIT", 3)
    two = ann.nearest(df, F.col("vec_id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    assert one.vec_id.tolist() == two.vec_id.tolist()


def test_recall(spark):
    got = ann.op5_ann(spark, "/root/testdata/sf0.01").toPandas()
    table = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest(list(zip(table.vec_id, table.embedding.tolist())))
    hits = sum(len(set(got[got.query_id == i].vec_id) & {j for _, j in near}) for i, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_on_scaled_clustered_and_mixed_vectors(spark):
    """With the query's own probes."""
    rng = np.random.default_rng(11)
    unit = lambda n, d: (x := rng.normal(size=(n, d))) / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(8, 32) * 500
    kinds = [unit(500, 24) * 10, unit(500, 16) * 1e-3, centres[rng.integers(0, 8, 500)] + rng.normal(size=(500, 32)), unit(500, 20) * np.where(np.arange(500) % 25 == 0, 40, 1)[:, None]]
    rows = [(1000 * t + i, v.tolist()) for t, x in enumerate(kinds) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    want = brute_nearest(rows)
    for t in range(len(kinds)):
        near = {i: x for i, x in want.items() if i // 1000 == t}
        assert all((got.query_id == i).sum() == 10 for i in near)
        hits = sum(len(set(got[got.query_id == i].vec_id) & {j for _, j in x}) for i, x in near.items())
        assert hits >= 0.9 * sum(map(len, near.values())), (t, hits)


@pytest.mark.parametrize("k", [2, 5])
def test_perturbations_come_in_order_of_cost(k):
    rng = np.random.default_rng(k)
    inside = rng.uniform(size=k)
    steps = ann.perturbations(inside, 3**k)
    cost = [sum(inside[i] ** 2 if s < 0 else (1 - inside[i]) ** 2 for i, s in enumerate(x) if s) for x in steps]
    assert len({tuple(x) for x in steps}) == len(steps) == 3**k and all(a <= b + 1e-12 for a, b in zip(cost, cost[1:]))
