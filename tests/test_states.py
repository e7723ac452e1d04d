"""Keyed stream state over several runs of one checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.streaming import state
from sluice.streaming.state import FileStream


def put(spark, folder, rows, schema="k string, at long, v string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "in")


def stream(spark, folder, tmp_path, plan, schema="k string, at long, v string", files=64):
    return FileStream(spark, folder, spark.createDataFrame([], schema).schema, plan, str(tmp_path / "query"), files)


def test_runs_of_one_checkpoint_take_in_each_file_once(spark, folder, tmp_path):
    plan = lambda s: s.select("k", "at", F.col("_metadata.file_name").alias("file"))
    rows = [("a", i, "x") for i in range(10)]
    put(spark, folder, rows[:4])
    put(spark, folder, rows[4:7])
    first = stream(spark, folder, tmp_path, plan).run()
    assert sum(p["numInputRows"] for p in first) == 7
    assert stream(spark, folder, tmp_path, plan).run() == []  # nothing new
    put(spark, folder, rows[7:])
    again = stream(spark, folder, tmp_path, plan)  # a new query object, as after a stop
    assert sum(p["numInputRows"] for p in again.run()) == 3
    got = again.result()
    assert sorted(r["at"] for r in got.collect()) == list(range(10))
    assert got.groupBy("file").agg(F.countDistinct("batch").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("files", [1, 64])
def test_first_by_position_whatever_the_order(spark, folder, tmp_path, files):
    rng = random.Random(files)
    rows = [(rng.choice(["a", "b", "c", None]), i, f"v{i}") for i in range(60)]
    rng.shuffle(rows)
    plan = lambda s: state.first_by_position(s, F.col("k"), F.col("at"))
    for part in (rows[:20], rows[20:25], rows[25:]):
        put(spark, folder, part)
        run = stream(spark, folder, tmp_path, plan, files=files)
        run.run()
    want = {k: min(r for r in rows if r[0] == k) if k else min((r for r in rows if r[0] is None), key=lambda r: r[1]) for k in {r[0] for r in rows}}
    assert {r.k: tuple(r) for r in state.firsts(run.result()).collect()} == want


def test_a_collision_fails_the_stream_in_a_later_run(spark, folder, tmp_path):
    plan = lambda s: state.collisions(s, F.col("k"), F.col("v"))
    put(spark, folder, [("a", 1, "p"), ("b", 2, "q"), ("a", 3, "p"), ("n", 4, None), ("n", 5, None)])
    stream(spark, folder, tmp_path, plan).run()
    put(spark, folder, [("b", 4, "q"), ("a", 5, "other")])
    with pytest.raises(Exception, match="key collision with different plans: a"):
        stream(spark, folder, tmp_path, plan).run()


def test_progress_by_rows_or_time(spark, folder, tmp_path):
    schema = "k string, at long, s double"
    plan = lambda s: state.progress(s, F.col("k"), F.col("at"), F.timestamp_seconds("s"), 3, 10)
    put(spark, folder, [("a", 2, 1.0), ("a", 1, 0.0), ("b", 3, 0.0)], schema)
    stream(spark, folder, tmp_path, plan, schema).run()
    put(spark, folder, [("a", 4, 2.0), ("a", 5, 11.9), ("a", 6, 12.0), ("b", 7, 9.9), ("b", 8, 30.0)], schema)
    run = stream(spark, folder, tmp_path, plan, schema)
    run.run()
    got = sorted((r.key, r.position, r.processed, r.rows_since, r.by) for r in run.result().collect())
    assert got == [("a", 4, 3, 3, "rows"), ("a", 6, 5, 2, "time"), ("b", 8, 3, 3, "rows")]


def test_consumed_sets_end_with_their_step(spark, folder, tmp_path):
    schema = "k string, step long, at long, i long"
    plan = lambda s: state.consumed_sets(s, F.col("k"), F.col("step"), F.col("at"), F.col("i"))
    put(spark, folder, [("a", 0, 0, 5), ("a", 0, 1, 6), ("a", 0, 2, 5)], schema)
    stream(spark, folder, tmp_path, plan, schema).run()
    put(spark, folder, [("a", 0, 3, 6), ("a", 1, 4, 6), ("a", 1, 5, 6), ("a", 2, 6, 6)], schema)
    run = stream(spark, folder, tmp_path, plan, schema)
    run.run()
    assert [r.fresh for r in run.result().orderBy("position").collect()] == [True, True, False, False, True, False, True]
    put(spark, folder, [("a", 1, 9, 9)], schema)
    with pytest.raises(Exception, match="step 1 came after step 2"):
        stream(spark, folder, tmp_path, plan, schema).run()


def test_stages_have_bounded_rows(spark, tmp_path, monkeypatch):
    """F8: one key may have all rows of a stage, and its task holds them; so stages follow the number of rows."""
    from sluice.plans import states
    from sluice.plans.catalog import Tables
    from sluice.streaming import state

    monkeypatch.setattr(state, "STAGE_ROWS", 1000)
    spark.range(10_000).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    sizes = [s.count() for s in states._in_order(Tables(spark, str(tmp_path)))]
    assert sum(sizes) == 10_000 and len(sizes) == 10 and max(sizes) < 1200


def test_only_the_fields_of_rows_are_held_in_order():
    """F8."""
    from pyspark.sql import Row

    from sluice.streaming.state import _brought

    rows = (Row(key="k", position=p, step=p // 2, index=9 - p) for p in (3, 1, 2))
    assert _brought(rows, "position", "step", "index") == ("k", [(1, 0, 8), (2, 1, 7), (3, 1, 6)])
