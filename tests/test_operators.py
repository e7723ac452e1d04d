"""Operators on small inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import arrays as A
from sluice.functions import numeric as N
from sluice.functions import text as X
from sluice.operators import identity, joins, reject, sampling
from sluice.operators import temporal as T
from sluice.sources import annotations, discovery


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_first_reason_keeps_the_order_of_checks(spark):
    df = spark.createDataFrame([(1, ""), (2, "abc"), (3, None)], "id int, s string")
    got = reject.with_reason(df, [("blank", reject.blank("s")), ("short", F.length("s") < 5)])
    assert {r.id: r.reason for r in got.collect()} == {1: "blank", 2: "short", 3: "blank"}
    accepted, rejected = reject.split_rows(got)
    assert accepted.count() == 0 and rejected.count() == 3


@pytest.mark.parametrize("crop,bad", [([0, 0, 5, 5], False), ([0, 0, 11, 5], True), ([5, 0, 5, 5], True), ([0, 0, 5], True), (None, False)])
def test_crop(spark, crop, bad):
    df = spark.createDataFrame([(crop,)], "crop array<double>" if crop is None else "crop array<int>")
    assert bool(df.select(F.coalesce(reject.crop_problem(F.col("crop"), F.lit(10), F.lit(10)), F.lit(False)).alias("b")).first().b) is bad


def test_strictly_increasing(spark):
    r = one(spark, *[reject.strictly_increasing(F.array(*map(F.lit, a)) if a else F.array().cast("array<int>")) for a in ([1, 2, 5], [1, 1], [3, 2], [7], [])])
    assert list(r) == [True, False, False, True, False]


def test_preflight_looks_at_the_first_row_and_into_structs(spark):
    df = spark.createDataFrame([(1, ("x", None))], "id int, meta struct<a:string,b:string>")
    assert reject.preflight(df, ["id", "meta.a", "meta.b", "gone"]) == ["meta.b", "gone"]


def test_dedup_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2)], "id int, k string, at int")
    assert {r.k: r.id for r in identity.dedup(df, ["k"], ["at"]).collect()} == {"a": 2, "b": 3}
    assert {r.k: r.id for r in identity.dedup(df, ["k"], ["at"], last=True).collect()} == {"a": 1, "b": 3}


def test_content_key_does_not_shift_nulls(spark):
    r = one(spark, identity.content_key(F.lit(None).cast("string"), F.lit("a")), identity.content_key(F.lit("a"), F.lit(None).cast("string")))
    assert r.c0 != r.c1


def test_collision_fails_when_read(spark):
    df = spark.createDataFrame([("k", "p"), ("k", "q")], "k string, plan string")
    with pytest.raises(Exception, match="different plans"):
        identity.assert_no_collision(df, ["k"], "plan").collect()
    assert identity.collisions(df, ["k"], F.col("plan")).first().n_plans == 2


def test_row_index_counts_on_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(6)
    assert all(r.v == r.row_index for r in identity.with_row_index(df, ["v"]).collect())


def test_interval_overlap_equals_nested_loop(spark):
    a = [(i, i * 3 % 50, i * 3 % 50 + 1 + i % 9) for i in range(40)]
    b = [(i, i * 7 % 50, i * 7 % 50 + 1 + i % 5) for i in range(40)]
    left, right = spark.createDataFrame(a, "a int, s int, e int"), spark.createDataFrame(b, "b int, s2 int, e2 int")
    got = {(r.a, r.b) for r in joins.interval_overlap(left, right, ("s", "e"), ("s2", "e2"), 6).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]}


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 4, "x"), (1, 10, "y"), (2, 3, "z")], "k int, at int, v string")
    assert {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", "at", "v").collect()} == {(1, 5): "x", (1, 10): "y", (2, 1): None}


def test_interval_overlap_of_mixed_lengths(spark):
    """Lengths from none to over the whole range, with nulls and repeated rows, each pair once."""
    a = [(i, i * 37 % 900, i * 37 % 900 + [0, 1, 7, 64, 1000][i % 5]) for i in range(60)] + [(99, None, 5), (98, 3, None)]
    b = [(i, i * 53 % 900 - 20, i * 53 % 900 - 20 + [300, 2, 0, 2500, 15][i % 5]) for i in range(60)]
    left, right = spark.createDataFrame(a, "a int, s int, e int"), spark.createDataFrame(b, "b int, s2 int, e2 int")
    for width in (1, 6, 5000):
        got = sorted((r.a, r.b) for r in joins.interval_overlap(left, right, ("s", "e"), ("s2", "e2"), width).collect())
        full = [x for x in a if x[1] is not None and x[2] is not None and x[1] < x[2]]
        assert got == sorted((x[0], y[0]) for x in full for y in b if y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    none = left.where("false")
    assert joins.interval_overlap(none, right, ("s", "e"), ("s2", "e2"), 6).count() == 0


def test_asof_of_a_hot_key_over_many_ranges(spark):
    """One key holds most rows, so its values are carried over ranges; ties, null values and null keys too."""
    right = [(1, i * 3, None if i % 11 == 0 else f"v{i:04d}") for i in range(400)] + [(1, 30, "v0010b"), (2, 5, "z"), (None, 7, "n"), (3, 1, None)]
    left = [(1, i * 5 % 1300 - 10) for i in range(500)] + [(2, 4), (2, 5), (None, 9), (3, 2), (4, 1)]

    def latest(k, t):
        met = [(at, v) for key, at, v in right if key == k and at <= t and v is not None]
        return max(met)[1] if met else None

    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, at int, v string")
    got = sorted(((r.k, r.t, r.v) for r in joins.asof_join(a, b, ["k"], "t", "at", "v").collect()), key=str)
    assert got == sorted(((k, t, latest(k, t)) for k, t in left), key=str)
    assert joins.asof_join(a, b.where("false"), ["k"], "t", "at", "v").where("v is null").count() == len(left)


def test_resample_plan_rounds_half_to_even(spark):
    r = one(spark, T.resample_plan(F.lit(0), F.lit(36.0), 24.0, 4))
    assert r.c0 == [0, 2, 3, 4]


def test_tiles(spark):
    r = one(spark, T.tiles_by_size(F.lit(20), 12, 4), T.tiles_by_size(F.lit(9), 12, 4), T.tiles_by_count(F.lit(11), 3, 2))
    assert [(x.start, x.end) for x in r.c0] == [(0, 12), (8, 20)]
    assert [(x.start, x.end, x.left_ramp, x.right_ramp) for x in r.c1] == [(0, 9, 0, 0)]
    assert [x.start for x in r.c2] == [0, 3, 6] and r.c2[-1].end == 11


def test_stride_walk_visits_all():
    for n in (1, 2, 7, 12, 100):
        start, stride = sampling.stride_walk(n, "seed")
        assert sorted((start + i * stride) % n for i in range(n)) == list(range(n))


def test_walk_position_inverts_the_walk(spark):
    start, stride = sampling.stride_walk(12, "s")
    rows = spark.range(12).select("id", sampling.walk_position(F.col("id"), 12, "s").alias("p")).collect()
    assert all((start + r.p * stride) % 12 == r.id for r in rows)


def test_apportion_gives_all_away(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, n long")
    assert {r.name: r.quota for r in sampling.apportion(df, "n", "name", 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_text_functions(spark):
    r = one(spark, X.path_list(F.lit(" a ;b| ;c")), X.path_list(F.lit('["x", " y "]')), X.safe_id(F.lit("a/b")), X.safe_id(F.lit("..x")), X.safe_id(F.lit("_a b.")), X.clean_typography(F.lit("123")), X.strip_opening(F.lit(" The image shows  x ")), X.model_response(F.lit('{"caption": "cut off')), X.clock(F.lit(3725)))
    assert list(r) == [["a", "b", "c"], ["x", "y"], None, None, "a_b", "123", "x", "cut off", "01:02:05"]


def test_numeric_and_array_functions(spark):
    r = one(spark, N.align_up(F.lit(33), 32), N.centre_crop(F.lit(200), F.lit(100), 1.0)[0], A.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), A.forward_pad(F.array(F.lit(1), F.lit(2)), F.lit(4)), A.split_sizes(F.lit(10), 4))
    assert list(r) == [64, 50, 11.0, [1, 2, 2, 2], [4, 4, 2]]


def test_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": " ", "n": 2}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"n": 1}, {"n": 2}]))
    (tmp_path / "c.json").write_text(json.dumps({"k1": {"n": 1}, "k2": {"n": 2}}))
    (tmp_path / "d.csv").write_text("id,n\n1,2\n")
    path = lambda n: str(tmp_path / n)
    assert annotations.scan(spark, path("a.jsonl")).count() == 2
    assert sorted(r.line_number for r in annotations.scan_lines(spark, path("a.jsonl")).collect()) == [1, 3]
    (tmp_path / "p.txt").write_text("one\ntwo\n")
    (tmp_path / "q.txt").write_text("a/1\na/2\n")
    assert [(r.caption, r.path) for r in annotations.caption_pairs(spark, path("p.txt"), path("q.txt")).collect()] == [("one", "a/1"), ("two", "a/2")]
    assert annotations.scan(spark, path("b.json")).count() == 2
    assert {r._record_key: r.n for r in annotations.scan(spark, path("c.json")).collect()} == {"k1": 1, "k2": 2}
    assert annotations.scan(spark, path("d.csv")).dtypes == [("id", "string"), ("n", "string")]
    with pytest.raises(ValueError):
        annotations.scan(spark, path("e.txt"))
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\n{broken\n')
    with pytest.raises(Exception):
        annotations.scan(spark, path("bad.jsonl"), "n int").collect()
    ids = annotations.scan(spark, path("a.jsonl")).select(annotations.row_id(F.lit(7), ["id", "n"]).alias("r")).collect()
    assert sorted(r.r for r in ids) == ["7", "x"]


def test_discovery():
    config = {"datasets": [{"name": "a", "task": "i2i", "path": "p"}, {"name": "b", "task": "i2i", "ann_path": "q"}], "data_root": "/d"}
    found = discovery.discover(config, {"p": 5, "q": 9}.__getitem__, ("i2i",), max_per_task=8)
    assert [(s.task_start_row, s.task_end_row) for s in found] == [(0, 5), (5, 8)]
    with pytest.raises(ValueError):
        discovery.discover(config, lambda p: 1, ("r2v",))
    assert discovery.build_fingerprint(found, {}) != discovery.build_fingerprint(found, {"x": 1})
    assert discovery.parse_tasks(" R2V, i2i") == ("i2i", "r2v")


def test_runs_of_equal_values_over_ranges(spark):
    import itertools
    import random

    from sluice.operators.ranges import equal_runs

    rng = random.Random(7)
    rows = [(k, i, rng.choice(["a", "a", "b", None])) for i, k in enumerate([1] * 300 + [None] * 40 + [2] * 3 + [3])]
    rows += [(9, 1000 + i, "same") for i in range(200)]
    want = []
    for k, of in itertools.groupby(rows, key=lambda r: r[0]):
        for v, run in itertools.groupby(of, key=lambda r: r[2]):
            at = [r[1] for r in run]
            want.append((k, v, at[0], at[-1], len(at)))
    df = spark.createDataFrame(rows, "k int, at int, v string")
    assert sorted(map(tuple, equal_runs(df.repartition(5), "k", "at", "v").collect()), key=str) == sorted(want, key=str)
    assert equal_runs(df.limit(0), "k", "at", "v").count() == 0
