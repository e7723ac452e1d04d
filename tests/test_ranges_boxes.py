"""Ordered scans with a carry over a hot key, and interval joins with crowded cells."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import joins
from sluice.operators.ranges import folded, numbered


def hot(seed=3):
    """One key for half of the rows, one null key, small keys."""
    rng = random.Random(seed)
    keys = ["hot"] * 200 + [None] * 40 + [f"k{rng.randrange(40)}" for _ in range(160)]
    rng.shuffle(keys)
    return [(k, i, rng.choice([None, *range(20)])) for i, k in enumerate(keys)]


def test_places_of_a_hot_key(spark):
    rows = hot()
    got = numbered(spark.createDataFrame(rows, "k string, at long, v long").repartition(3), ["k"], ["at"], "n")
    seen = {}
    want = []
    for k, at, v in rows:
        want.append((k, at, v, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert numbered(spark.createDataFrame([], "k string, at long"), ["k"], ["at"], "n").count() == 0


def test_no_task_holds_a_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = numbered(rows, ["k"], ["id"], "n")
    parts = got.where("k = 'hot'").select("n").withColumn("p", F.floor(F.col("n") / 10_000)).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 10_000
    ranges = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy("_range").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 10_000  # windows run within ranges


def test_folds_over_ranges(spark):
    rows = hot(4)
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    #: the recurrence a = a / 2 + v, as a chain of affine maps
    from pyspark.sql import Window

    columns = lambda w: {"x": F.coalesce("v", F.lit(0)) * F.pow(F.lit(0.5), F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing)))}
    got = folded(df, ["k"], ["at"], columns, {"n": F.count(F.lit(1)), "b": F.sum("x")}, F.lit(0.0), lambda a, p: a * F.pow(F.lit(0.5), p["n"]) + p["b"], "r")
    want = {}
    for k, _, v in rows:
        want[k] = want.get(k, 0.0) / 2 + (v or 0)
    assert {r.k: pytest.approx(r.r) for r in got.collect()} == want


def boxes(rng, n, m, spread):
    out = []
    for i in range(n):
        low = [rng.randrange(spread) for _ in range(3)]
        out.append((i, *[v for x in low for v in (x, x + rng.randrange(0, 9))]))
    out.append((n, None, 3, 1, 2, 1, 2))
    return out, f"{m} int, " + ", ".join(f"{m}{k}{e} int" for k in "xyz" for e in ("0", "1"))


@pytest.mark.parametrize("pairs", [1, 50, 1 << 24])
@pytest.mark.parametrize("spread", [4, 60])
def test_boxes_that_overlap(spark, pairs, spread):
    rng = random.Random(spread)
    (a, ka), (b, kb) = boxes(rng, 60, "a", spread), boxes(rng, 70, "b", spread)
    axes = [((f"a{k}0", f"a{k}1"), (f"b{k}0", f"b{k}1"), w) for k, w in (("x", 5), ("y", 3), ("z", 40))]
    got = joins.box_overlap(spark.createDataFrame(a, ka), spark.createDataFrame(b, kb), axes, pairs=pairs)
    meet = lambda p, q: all(p[i] is not None and p[i] < p[i + 1] and q[i] is not None and q[i] < q[i + 1] and p[i] < q[i + 1] and q[i] < p[i + 1] for i in (1, 3, 5))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((p[0], q[0]) for p in a for q in b if meet(p, q))
    assert got.columns == [c.split()[0] for c in f"{ka}, {kb}".split(", ")]


@pytest.mark.parametrize("pairs", [1, 20, 1 << 24])
def test_crowded_bins_of_intervals(spark, pairs):
    rng = random.Random(pairs)
    make = lambda n: [(i, s := rng.randrange(50), s + rng.choice([0, 1, 3, 200])) for i in range(n)]
    a, b = make(60), make(80)
    got = joins.interval_overlap(spark.createDataFrame(a, "a int, s long, e long"), spark.createDataFrame(b, "b int, t long, f long"), ("s", "e"), ("t", "f"), 5, pairs=pairs)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])


def test_a_crowded_cell_is_dealt_over_parts(spark):
    x = spark.range(300).select(F.lit(1).alias("c"), F.col("id").alias("i"))
    y = spark.range(200).select(F.lit(1).alias("c"), F.col("id").alias("j"))
    parts = joins._met_in_parts(x, y, ["c"], 1000)
    assert parts.count() == 60_000 and parts.select("i", "j").distinct().count() == 60_000
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan


def test_few_small_rows_with_many_pairs_are_dealt_over_tasks(spark, monkeypatch):
    """Adaptive execution would put a few kilobytes into one task, however many pairs they make."""
    monkeypatch.setattr(joins, "PAIRS", 1 << 14)
    x = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 400).alias("s"), (F.col("id") % 400 + 3).alias("e"))
    y = spark.range(3000).select(F.col("id").alias("j"), (F.col("id") % 400).alias("t"), (F.col("id") % 400 + 2).alias("f"))
    got = joins.interval_overlap(x, y, ("s", "e"), ("t", "f"), 5)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    want = sum(5 * (7 + (t < 200)) for s in range(400) for t in range(400) if s < t + 2 and t < s + 3)
    assert sum(r["count"] for r in tasks) == want
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < want / 2


def test_the_interval_query_lists_every_pair(spark, sf):
    from sluice import registry

    got = registry.QUERIES["interval_overlap_join"](spark, sf)
    assert got.columns == ["a_key", "b_key"]
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", F.unix_date(F.col("o_orderdate").cast("date")).alias("day")).collect()
    span = lambda r: (r.o_orderkey, r.day, r.day + 1 + r.o_orderkey % 5)
    a, b = [span(r) for r in rows if r.o_orderstatus == "P"], [span(r) for r in rows if r.o_orderstatus != "P"]
    assert sorted(map(tuple, got.collect())) == sorted((p[0], q[0]) for p in a for q in b if p[1] < q[2] and q[1] < p[2])


def test_copies_to_the_parts_of_a_crowded_bin_grow_with_rows(spark):
    """pairs grow with the square of rows, what is shuffled for them must not."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(n):
        x = spark.range(n).select(F.col("id").alias("i"), F.lit(0).alias("s"), F.lit(3).alias("e"))
        y = spark.range(n).select(F.col("id").alias("j"), F.lit(1).alias("t"), F.lit(2).alias("f"))
        got = joins.interval_overlap(x, y, ("s", "e"), ("t", "f"), 5, pairs=1)
        group = f"copies-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert got.agg(F.count("i"), F.countDistinct("i"), F.countDistinct("j")).first() == (n * n, n, n)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = {k for job in spark.sparkContext.statusTracker().getJobIdsForGroup(group) for k in spark.sparkContext.statusTracker().getJobInfo(job).stageIds}
        read = [store.lastStageAttempt(k) for k in stages if not spark.sparkContext.statusTracker().getStageInfo(k) is None]
        return max(s.shuffleReadRecords() for s in read if s.status().toString() == "COMPLETE")

    small, large = shuffled(300), shuffled(600)
    assert 600 <= small and large < 2.3 * small and large < 600 * 2 * 70


def test_repeated_rows_that_meet_as_one_keep_their_number(spark):
    x = spark.createDataFrame([(i % 3, "u" if i % 2 else None, 4, 9) for i in range(30)], "i int, k string, s int, e int")
    y = spark.createDataFrame([(j % 2, 8, 8 + j % 3) for j in range(12)], "j int, t int, f int")
    for pairs in (1, 20, joins.PAIRS):
        got = joins.interval_overlap(x, y, ("s", "e"), ("t", "f"), 5, pairs=pairs)
        assert got.columns == ["i", "k", "s", "e", "j", "t", "f"]
        assert sorted(got.collect(), key=str) == sorted(x.join(y, F.expr("s < f and t < e and t < f")).collect(), key=str)
        bare = joins.interval_overlap(x.select("s", "e"), y, ("s", "e"), ("t", "f"), 5, pairs=pairs)
        assert bare.columns == ["s", "e", "j", "t", "f"] and bare.count() == 30 * 8


def test_tasks_of_a_sparse_join_follow_its_rows(spark, monkeypatch):
    """cells with few pairs make tasks by rows, so a task's memory does not grow with the tables."""
    monkeypatch.setattr(joins, "ROWS", 500)
    x = spark.range(3000).select(F.col("id").alias("i"), F.col("id").alias("c"))
    y = spark.range(3000).select(F.col("id").alias("j"), F.col("id").alias("c"))
    tasks = joins._met_in_parts(x, y, ["c"], joins.PAIRS).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 3000 and len(tasks) > 8 and max(r["count"] for r in tasks) < 600


@pytest.mark.parametrize("pairs, few, shuffles", [(1 << 24, 1, 2), (5001, 1, 2), (5001, 0, 6)])
def test_rows_are_shuffled_once_unless_many_cells_are_crowded(spark, monkeypatch, pairs, few, shuffles):
    """rows went through two shuffles and a join with crowded cells even where there are none."""
    monkeypatch.setattr(joins, "CROWDED", few)
    monkeypatch.setattr(joins, "ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = spark.range(300).select((F.col("id") % 3 % 2).alias("c"), F.col("id").alias("i"))
        y = spark.range(100).select((F.col("id") % 4 % 3).alias("c"), F.col("id").alias("j"))
        met = joins._met_in_parts(x, y, ["c"], pairs)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles
        assert sorted(map(tuple, met.select("i", "j").collect())) == [(i, j) for i in range(300) for j in range(100) if i % 3 % 2 == j % 4 % 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
