"""Generations, shard markers with hashes, and source discovery."""

import os

import pytest
from pyspark.sql import functions as F

from sluice.operators import generations as G
from sluice.operators import publish as P
from sluice.sources import discovery


def test_readers_keep_their_generation(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(FileNotFoundError):
        G.Current(spark, root)
    for n in (3, 5):
        with G.Generation(spark, root) as g:
            g.stage("rows", spark.range(n))
            g.stage("lines", spark.range(n).select(F.lit("x").alias("v")), "json")
        if n == 3:
            old = G.Current(spark, root)
    new = G.Current(spark, root)
    assert old.read("rows").count() == old.read("lines").count() == 3 and new.read("rows").count() == new.read("lines", content=True).count() == 5
    assert new.history() == [old.id, new.id] and {f["name"].split("/")[0] for f in new.files()} == {"rows", "lines"}


@pytest.mark.parametrize("stop", ["between tables", "before the marker", "before the pointer"])
def test_a_run_that_ends_early_changes_nothing(spark, tmp_path, monkeypatch, stop):
    root = str(tmp_path / "root")
    with G.Generation(spark, root) as g:
        g.stage("rows", spark.range(3))
        g.stage("more", spark.range(4))

    def fail(*_):
        raise KeyboardInterrupt

    if stop == "before the marker":
        monkeypatch.setattr(G._Files, "put", fail)
    if stop == "before the pointer":
        monkeypatch.setattr(G._Files, "replace", fail)
    with pytest.raises(KeyboardInterrupt), G.Generation(spark, root) as g:
        g.stage("rows", spark.range(30))
        if stop == "between tables":
            fail()
        g.stage("more", spark.range(40))
    now = G.Current(spark, root)
    assert now.read("rows", content=True).count() == 3 and now.read("more", content=True).count() == 4 and len(now.history()) == 1


def test_files_that_differ_are_refused(spark, tmp_path):
    root = str(tmp_path / "root")
    with G.Generation(spark, root) as g:
        g.stage("rows", spark.range(30).coalesce(1))
        g.stage("other", spark.range(3))
    now = G.Current(spark, root)
    folder = f"{root}/generations/{now.id}/tables/rows"
    name = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    with open(f"{folder}/{name}", "r+b") as f:  # as long as before
        f.seek(20)
        f.write(b"?")
    assert now.changed().count() == 0
    with pytest.raises(ValueError, match="differ from their marker: rows/"):
        now.read("rows", content=True)
    assert now.read("other", content=True).count() == 3
    os.remove(f"{folder}/{name}")
    with pytest.raises(ValueError, match="differ"):
        now.read("rows")


def test_a_bundle_is_a_folder_per_sample(spark, tmp_path):
    root = str(tmp_path / "root")
    with G.Generation(spark, root) as g:
        g.stage("bundle", spark.createDataFrame([("s1", "one prompt"), ("s2", "two")], "sample string, prompt string"), "text", ["sample"])
    now = G.Current(spark, root)
    assert sorted(os.listdir(f"{now.base}/tables/bundle"))[-2:] == ["sample=s1", "sample=s2"]
    assert {r.sample: r.value for r in now.read("bundle").collect()} == {"s1": "one prompt", "s2": "two"}


def shards(spark, n=40):
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, "i2i").otherwise("r2v").alias("task"), (F.col("id") % 3).cast("int").alias("shard"), "id", F.when(F.col("id") % 5 == 0, "five").when(F.col("id") % 7 == 0, "seven").alias("reason"))


def test_damaged_shards_are_written_anew(spark, tmp_path):
    path, df = str(tmp_path / "build"), shards(spark)
    assert P.publish_shards(df, path, "f") == 6 and P.publish_shards(df, path, "f") == 0
    folder = f"{path}/data/task=i2i/shard=1"
    os.remove(f"{folder}/{next(f for f in os.listdir(folder) if f.endswith('.parquet'))}")
    other = f"{path}/data/task=r2v/shard=2"
    name = next(f for f in os.listdir(other) if f.endswith(".parquet"))
    with open(f"{other}/{name}", "r+b") as f:
        f.seek(10)
        f.write(b"?")
    assert P.done_shards(spark, path).count() == 4
    assert P.publish_shards(df, path, "f") == 2
    assert sorted(r.id for r in spark.read.parquet(f"{path}/data").collect()) == list(range(40))
    counters = P.shard_counters(spark, path, "f")
    assert counters.agg(F.sum("n_rows"), F.sum("accepted"), F.sum("rejected")).first() == (40, 28, 12)
    reasons = counters.select(F.explode("reasons").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    assert {r.r: r.n for r in reasons} == {"five": 8, "seven": 4}
    assert P.publish_shards(df, path, "g") == 6 and P.shard_counters(spark, path, "f").count() == 0  # overwritten by another build


def test_discovery_rules(tmp_path):
    config = {
        "data_root": "/d",
        "datasets": [
            {"task": "I2I", "path": "a", "adapter": {"k": 1}, "dataset_type": "t"},
            {"name": "empty", "task": "i2i", "path": "none"},
            {"name": "b", "task": "i2i", "parquet": "b", "data_root": "/own"},
            {"name": "late", "task": "i2i", "path": "c"},
            {"name": "other", "task": "r2v", "path": "none"},
        ],
    }
    rows = {"a": 5, "b": 9, "c": 2, "none": 0}.__getitem__
    found = discovery.discover(config, rows, ("i2i",), max_per_task=8)
    assert [(s.name, s.order, s.task_start_row, s.task_end_row, s.data_root) for s in found] == [("dataset_0", 0, 0, 5, "/d"), ("b", 2, 5, 8, "/own")]
    assert found[0].settings == {"dataset_type": "t", "adapter": {"k": 1}} and found[1].settings["adapter"] == {}
    with pytest.raises(ValueError, match="no dataset with rows for task r2v"):
        discovery.discover(config, rows, ("r2v",))
    with pytest.raises(ValueError, match="x has no annotation path"):
        discovery.discover({"datasets": [{"name": "x", "task": "i2i"}]}, rows, ("i2i",))

    def stat(path):
        info = os.stat(tmp_path / path)
        return info.st_size, info.st_mtime_ns

    with pytest.raises(FileNotFoundError):
        discovery.discover(config, rows, ("i2i",), stat=stat)
    for name in ("a", "b", "c", "none"):
        (tmp_path / name).write_text("x")
    one = discovery.discover(config, rows, ("i2i",), stat=stat)
    os.utime(tmp_path / "b", ns=(1, 1))  # changed in place, with as many rows
    two = discovery.discover(config, rows, ("i2i",), stat=stat)
    assert [x.fingerprint == y.fingerprint for x, y in zip(one, two)] == [True, False, True]
    assert discovery.build_fingerprint(one, {}) != discovery.build_fingerprint(two, {})
    with pytest.raises(ValueError, match="no such task"):
        discovery.parse_tasks("i2i,x")
    with pytest.raises(ValueError, match="a task is needed"):
        discovery.parse_tasks(" , ")
