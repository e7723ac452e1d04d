"""Clashing columns, repeated and null ids, hot ids and lists of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontaminate, keys, packing, simhash, toxicity, url_filter

ITEM = "one two three four five six seven eight nine ten eleven twelve"
CLEAN = "quite other words that stand in no item at all and are kept"


def test_only_rows_that_leak_go(spark):
    rows = [(None, ITEM), (None, CLEAN), (1, ITEM), (1, CLEAN), (2, CLEAN), (2, CLEAN), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = sorted(map(str, decontaminate.drop_leaks(docs, items).collect()))
    assert got == sorted(map(str, docs.where(~F.col("text").eqNullSafe(ITEM)).collect()))
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.drop_leaks(docs.limit(0), items).count() == 0


HELPERS = "_id _w _b _maybe _bits _key _name _place _rest _url _x _lanes k n p h sh at one word".split()


def test_columns_named_like_helpers_stay(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, CLEAN), (3, CLEAN)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(c).alias(c) for c in HELPERS])
    items = spark.createDataFrame([(7, ITEM, "x", "y")], "item_id long, text string, k string, sh string")
    for got, left in ((decontaminate.drop_leaks(docs, items), {2, 3}), (simhash.first_of_groups(docs), {1, 2})):
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == left
        assert all(r[c] == c for r in got.collect() for c in HELPERS)
    listed = docs.where("doc_id = 2").select(F.col("doc_id").cast("string").alias("key"))
    named = docs.withColumn("id", F.col("doc_id").cast("string"))
    assert [r.doc_id for r in keys.with_keys(named, "id", listed).collect()] == [2]
    assert sorted(r.doc_id for r in keys.without_keys(named, "id", listed).collect()) == [1, 3]
    pages = docs.withColumn("url", F.lit("http://a.org/x")).withColumn("host", F.lit("old"))
    got = url_filter.judge(pages, url_filter.RULES, listed)
    assert all(r.host == "a.org" and r.verdict == "allow" and all(r[c] == c for c in HELPERS) for r in got.collect())
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_pieces_of_one_id_are_dealt_over_all_shards(spark):
    rows = spark.range(300_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 900 + 1).alias("length"), F.lit("x").alias("_shard"), F.lit(1).alias("offset"))
    got = packing.pack(rows, 2048)
    per = got.groupBy(F.shiftright("sequence_id", 32)).count().toPandas()["count"]
    assert len(per) == 5 and per.max() < 1.1 * packing.SHARD_PIECES and per.sum() == 300_000
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end or n > 2048").count() == 0 and got.where("_shard = 'x'").count() == 300_000


def test_a_cascade_that_outgrows_its_bits_is_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", 512)
    rows = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = rows.where("key in ('h7', 'h19', 'h333')")
    got = {r.key for r in url_filter.mark_listed(rows, "key", listed).where("listed").collect()}
    assert got == {"h7", "h19", "h333"}


def test_fingerprints_of_very_many_shingles(spark, monkeypatch):
    df = spark.createDataFrame([([3, 3, 5, -1],), ([7, -9, 1 << 40],)], "sh array<long>")
    few = [r.fp for r in decontaminate.with_fingerprint(df).collect()]
    monkeypatch.setattr(decontaminate, "LANE", 0)
    assert [r.fp for r in decontaminate.with_fingerprint(df).collect()] == few


def test_labels_that_differ_do_not_train(spark):
    rows = [(1, 1, 1), (1, 0, 1), (2, 1, 0), (2, 1, 0), (3, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (6, 1, None)]
    got = toxicity.labelled_grades(spark.createDataFrame(rows, "doc_id long, toxic int, quality int"))
    assert sorted((r._id, r._grade) for r in got.collect()) == [(2, 1), (3, 1), (4, 0), (6, 1)]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (50, 4))
    rows, cols = np.nonzero(x)
    grades = rng.integers(0, 3, 50)
    params = [rng.normal(size=4), np.array([0.3]), np.array([-0.2])]
    _, grads = toxicity.loss_and_gradients(rows, cols, grades, params, 0.01)
    for p, g in zip(params, grads):
        for i in range(len(p)):
            ends = []
            for step in (1e-6, -1e-6):
                p[i] += step
                ends.append(toxicity.loss_and_gradients(rows, cols, grades, params, 0.01)[0])
                p[i] -= step
            assert g[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_loss_equals_a_dense_reference():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (40, 5))
    grades, w, theta = rng.integers(0, 3, 40), rng.normal(size=5), np.array([-0.4, 0.9])
    rows, cols = np.nonzero(x)
    below = lambda j, z: 1.0 if j == 2 else 0.0 if j < 0 else 1 / (1 + np.exp(z - theta[j]))
    want = -np.mean([np.log(below(g, r @ w) - below(g - 1, r @ w)) for r, g in zip(x, grades)])
    got, _ = toxicity.loss_and_gradients(rows, cols, grades, [w, theta[:1], np.log(np.diff(theta))], 0.0)
    assert got == pytest.approx(want)


def test_grades_of_the_query_equal_a_dense_model(spark):
    """Every text scored by the trained weights, one by one, with a plain splitter."""
    rows = [(i, " ".join(["vile " * (i % 3 == 0), "rotten " * (i % 6 == 0), "kind", chr(97 + i % 26)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 6 == 0)) for i in range(120)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    assert len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    for i, text in rows:
        names = {f for w in text.split() for f in toxicity.features_of(w.encode())}
        score = sum(model.weights[model.features[f]] for f in names if f in model.features)
        p = 1 / (1 + np.exp(model.thresholds - score))
        assert got[i].severity == pytest.approx(p.sum()) and got[i].grade == (p >= 0.5).sum() and got[i].rejected == (p[0] >= model.cut)
    assert [got[i].grade for i in (0, 3, 1)] == [2, 1, 0]
