"""Adapters, validation, publishing and token state on small inputs."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import publish, tokens, validate
from sluice.operators.identity import content_key
from sluice.sources.adapters import REGISTRY, Settings, normalize, rewrite_keys, role_columns
from sluice.streaming.progress import first_wins, run_once

PHANTOM = "source_record_id string, video_path string, metadata struct<video_caption:string>, cropped_ref_paths array<string>, cross_pair struct<id:string>"


def test_phantom_reasons_and_distinct_references(spark):
    rows = [("1", "v.mp4", ("c",), ["a", "b", "a"], ("x",)), ("2", "v.mp4", (" ",), ["a"], ("x",)), ("3", None, ("c",), ["a"], ("x",)), ("4", "v.mp4", ("c",), ["a"], None), ("5", "/v.mp4", ("c",), [" "], ("x",))]
    got = {r.source_record_id: r for r in normalize(spark.createDataFrame(rows, PHANTOM), "phantom", Settings(data_root="/d")).collect()}
    assert [got[str(i)].reason for i in range(1, 6)] == [None, "phantom_empty_caption", "phantom_missing_target", "phantom_missing_cross_pair", "phantom_missing_reference"]
    assert got["1"].reference_paths == ["/d/a", "/d/b"] and got["5"].target_path == "/v.mp4"


def test_phantom_subset_is_seeded_and_keeps_order(spark):
    refs = [f"r{i}" for i in range(9)]
    df = spark.createDataFrame([("1", "v", ("c",), refs, ("x",))], PHANTOM)
    one = normalize(df, "phantom", Settings(max_reference_images=4, seed="1")).first().reference_paths
    two = normalize(df, "phantom", Settings(max_reference_images=4, seed="1")).first().reference_paths
    assert one == two == sorted(one) and len(one) == 4


def test_image_pairs_and_unknown_adapter(spark):
    df = spark.createDataFrame([("1", "t.png", "a; b|", " hi "), ("2", "t.png", ";", "hi")], "source_record_id string, image string, edit_image string, prompt string")
    got = {r.source_record_id: r for r in normalize(df, "i2i", Settings()).collect()}
    assert got["1"].caption == "hi" and len(got["1"].reference_paths) == 2 and got["2"].reason == "missing_reference"
    with pytest.raises(ValueError):
        normalize(df, "nothing", Settings())
    assert set(REGISTRY) == {"opens2v", "phantom", "i2i"}
    assert role_columns(["media_path", "x"], {"mask": "m"}) == {"video": "media_path", "x": "x", "mask": "m"}
    assert spark.range(1).select(rewrite_keys(F.lit("a.b.c"), [("a.", ""), ("b", "z")]).alias("k")).first().k == "z.c"


def manifest_row(**changes):
    anchors = [round(i * 120 / 11) for i in range(12)]
    row = {"sample_key": "k", "target_path": "/t", "source_record_id": "1", "caption": "c", "task": "r2v", "reference_paths": ["/a"], "target_width": 832, "target_height": 480, "clip_start_frame": 0, "clip_end_frame": 121}
    row |= {"target_source_frame_indices": list(range(121)), "semantic_anchor_target_indices": anchors, "semantic_anchor_source_indices": anchors}
    return row | changes


@pytest.mark.parametrize(
    "changes,reason",
    [
        ({}, None),
        ({"caption": " "}, "empty_caption"),
        ({"task": "x"}, "unknown_task"),
        ({"reference_paths": ["a"] * 5}, "reference_count_out_of_range"),
        ({"target_width": 1}, "geometry_mismatch"),
        ({"target_source_frame_indices": [0]}, "frame_list_length"),
        ({"target_source_frame_indices": [0, 0, *range(2, 121)]}, "frame_list_order"),
        ({"clip_end_frame": 100}, "frame_list_range"),
        ({"semantic_anchor_source_indices": [0] * 12}, "anchor_sources"),
    ],
)
def test_manifest_validation(spark, changes, reason):
    row = manifest_row(**changes)
    schema = "sample_key string, target_path string, source_record_id string, caption string, task string, reference_paths array<string>, target_width int, target_height int, clip_start_frame int, clip_end_frame int, target_source_frame_indices array<int>, semantic_anchor_target_indices array<int>, semantic_anchor_source_indices array<int>"
    df = spark.createDataFrame([tuple(row.values())], schema)
    fields = ["sample_key", "caption", "target_path"]
    df = df.withColumn("sample_plan_sha256", content_key(*fields))
    assert df.select(validate.manifest_reason(df, fields).alias("r")).first().r == reason
    wrong = df.withColumn("sample_plan_sha256", F.lit("x"))
    if reason is None:
        assert wrong.select(validate.manifest_reason(wrong, fields).alias("r")).first().r == "plan_hash_mismatch"


def test_ratios():
    validate.check_ratios({"a": 0.3, "b": 0.7}, ["b", "a"])
    for bad, names in (({"a": 1.0}, ["b"]), ({"a": 0.5}, ["a"]), ({"a": -1.0, "b": 2.0}, ["a", "b"])):
        with pytest.raises(ValueError):
            validate.check_ratios(bad, names)


def test_publish_and_path_policy(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 1), (1, None, 1), (3, "bad", 1)], "id int, reason string, _build_x int")
    out = publish.publish(df, str(tmp_path / "m"), ["id"], policy=publish.PathPolicy([str(tmp_path)]))
    assert spark.read.parquet(out["accepted"]).columns == ["id"] and spark.read.json(out["rejected"]).first().reason == "bad"
    assert {r.status: r.n for r in spark.read.json(out["summary"]).collect()} == {"accepted": 2, "bad": 1}
    policy = publish.PathPolicy(["/a", "s3://b/c"], ["/a/secret"])
    assert policy.check("/a/x") and policy.check("s3://b/c/d")
    for path in ("/ab", "/a/../b", "/a/secret/x", "s3://b/x"):
        with pytest.raises(PermissionError):
            policy.check(path)


def test_shards_resume_by_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([("i2i", i % 3, i) for i in range(9)], "task string, shard int, v int")
    path = str(tmp_path / "shards")
    assert publish.publish_shards(df.where("shard < 2"), path, "f1") == 2
    assert publish.publish_shards(df, path, "f1") == 1 and publish.publish_shards(df, path, "f1") == 0
    assert spark.read.parquet(f"{path}/data").count() == 9
    assert publish.publish_shards(df, path, "f2") == 3 and spark.read.parquet(f"{path}/data").count() == 9


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl", "txt"])
def test_caption_sinks(spark, tmp_path, kind):
    df = spark.createDataFrame([("b", "two"), ("a", "one, x")], "path string, caption string")
    publish.save_captions(df, str(tmp_path / kind), kind)
    if kind == "csv":
        assert spark.read.option("header", True).csv(str(tmp_path / kind)).count() == 2
    elif kind == "txt":
        assert [r.value for r in spark.read.text(str(tmp_path / kind / "captions")).collect()] == ["one, x", "two"]
    else:
        assert spark.read.json(str(tmp_path / kind)).count() == 2


def test_token_state(spark):
    state = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 2.0, 1.0)], "batch int, pos int, latent double, mask double")
    more = spark.createDataFrame([(0, 0), (0, 1)], "batch int, pos int")
    got = tokens.append_tokens(state, more, 0.25).orderBy("pos").collect()
    assert [(r.pos, r.latent, r.mask) for r in got] == [(0, 1.0, 1.0), (1, 2.0, 1.0), (2, 0.0, 0.75), (3, 0.0, 0.75)]
    assert [r.x for r in state.orderBy("pos").select(tokens.replace_range(F.col("latent"), F.col("pos"), 1, 2, F.lit(9.0)).alias("x")).collect()] == [1.0, 9.0]
    row = spark.range(1).select(tokens.integer_scale(F.lit(32), F.lit(8)).alias("s"), *[c.alias(n) for c, n in zip(tokens.clamp_tiles(F.lit(3), F.lit(5), F.lit(4)), "no")]).first()
    assert (row.s, row.n, row.o) == (4, 1, 2)
    with pytest.raises(Exception, match="divide"):
        spark.range(1).select(tokens.integer_scale(F.lit(30), F.lit(8))).collect()
    lists = spark.createDataFrame([(0, 2, [1]), (0, 1, [2, 3])], "b int, o int, v array<int>")
    assert tokens.collate(lists, "b", "o", "v", F.lit(0)).first().v == [[2, 3], [1, 0]]


def test_stream_first_wins_with_watermark(spark, sf):
    got = run_once(spark, sf, "events", lambda s: first_wins(s.withColumn("at", F.col("ts").cast("timestamp")), ["event_id"], ("at", "365 days")).select("event_id"), "append")
    assert got.count() == got.distinct().count() > 0
