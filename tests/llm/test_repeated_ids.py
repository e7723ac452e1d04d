"""Nearest neighbours where ids repeat, on the side of queries and of candidates, against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import ann


def lists(rows, k=10):
    """The list of every query row, sorted."""
    out = []
    for a, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((math.sqrt(((np.array(w) - np.array(v)) ** 2).sum()), j) for b, (j, w) in enumerate(rows) if b != a)
            out += [(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near[:k])]
    return sorted(out)


def rows_of(rng):
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows.append((7, rows[200][1]))  # another row's id with a query's vector
    rows.append((100, rows[60][1]))  # a query id with a second vector
    rows += [(200, rows[200][1])] * 3  # rows that are as a query's own
    rows += [(i, rows[0][1]) for i in (0, 0, 3, 3, 250)]  # a query's vector under many ids
    return rows


def test_exact_route_is_equal_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ann, "FAR", 0.0)
    rows = rows_of(np.random.default_rng(9))
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == lists(rows)


def test_more_equal_rows_than_neighbours(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
    rows = [(i, v) for i in range(90, 120)] + [(100, v), (5, w), (100, w)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == lists(rows, 4)


def test_production_probes_reach_their_recall(spark):
    rows = rows_of(np.random.default_rng(10))
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    want = lists(rows)
    assert len(got) == len(want)
    mine = sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in got)
    left = [(i, j, d) for i, _, j, d in want]
    hits = 0
    for x in mine:
        if x in left:
            left.remove(x)
            hits += 1
    assert hits >= 0.9 * len(want)
