"""The order of grades, and the cut that is fitted on rows that do not train."""

import random

import numpy as np

from sluice.llm import toxicity


def test_grades_follow_the_number_of_cue_words():
    names = [b"vile", b"rotten", b"^rott", b"filthy", b"plain"]
    held = [[0], [0, 1, 2], [0, 1, 2, 3], [4], [4], [4, 0], [3], [4]]
    toxic = np.array([1, 1, 1, 0, 0, 1, 1, 0])
    rows = np.concatenate([np.full(len(h), i) for i, h in enumerate(held)])
    assert toxicity.by_abuse(rows, np.concatenate(held), toxic, names).tolist() == [1, 2, 2, 0, 0, 1, 1, 0]
    same = np.array([0, 0, 3, 4])  # toxic rows with one cue each
    assert toxicity.by_abuse(np.array([0, 1, 2, 3]), same, np.array([1, 1, 1, 0]), names).tolist() == [1, 1, 1, 0]


def test_best_cut_is_the_best_on_a_grid():
    rng = np.random.default_rng(2)
    toxic = rng.integers(0, 2, 300)
    p = np.clip(0.35 * toxic + rng.uniform(0, 0.6, 300), 0, 1)
    cut, precision, recall, f1 = toxicity.best_cut(p, toxic)
    every = [2 * ((p >= c) & (toxic == 1)).sum() / ((p >= c).sum() + toxic.sum()) for c in np.arange(1, 20) / 20]
    assert f1 == max(every) and abs(2 * precision * recall / (precision + recall) - f1) < 1e-12
    assert toxicity.best_cut(np.array([0.0, 0.01, 0.99, 1.0]), np.array([0, 0, 1, 1]))[0] == 0.5  # of equal ones the middle


def test_the_cut_comes_from_rows_that_do_not_train(spark):
    """Where a cue word is in clean rows as well, the cut and its report say so."""
    rng = random.Random(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        text = rng.choices(words, k=20)
        toxic = i % 5 == 0
        if toxic or i % 25 == 1:
            text += rng.sample(["vile", "rotten", "filthy"], 1 if not toxic else 1 + i // 5 % 3)
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    report = model.held_out
    assert report["rows"] == 600 and len(model.thresholds) == 2 and 0.05 <= model.cut <= 0.95
    assert report["recall"] > 0.9 and 0.75 < report["precision"] < 0.95  # 120 toxic rows, 24 clean ones with a cue word
    assert abs(report["expected_1"] - report["share_1"]) < 0.05 and abs(report["expected_2"] - report["share_2"]) < 0.05 and report["ordered"] > 0.9
    rejected = {r.doc_id for r in toxicity.grade(docs, model).where("rejected").collect()}
    assert len(rejected & {i for i, t in marks if t}) > 110 and len(rejected - {i for i, t in marks if t}) <= 24
    strict = toxicity.drop_toxic(docs, model, reject=1.1)
    assert strict.count() == 600
