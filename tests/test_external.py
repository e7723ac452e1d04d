"""Evaluation sets from outside, bundles, reference checks, scans without an index, ratios and microbatches."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.operators import bundles as B
from sluice.operators import validate as V
from sluice.operators.publish import PathPolicy
from sluice.operators.tokens import collated
from sluice.sources import discovery
from sluice.sources import external as E
from sluice.sources.manifests import scan_manifest, scanned_entries
from sluice.sources.offsets import read_entries
from sluice.sources.prepare import finalize


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def normalized(spark, tmp_path, dataset, payload):
    path = put(tmp_path / "set.json", payload)
    return {r.source_index: r for r in E.normalize_external(E.read_external(spark, path, dataset), dataset, path).collect()}


def test_lists_of_records(spark, tmp_path):
    good = {"id": 7, "prompt": "\t a\nb \u2003", "ref_images": ["/a/../b//c.png", "C:\\x.png"]}
    rows = [good, "text", None, {**good, "id": None}, {**good, "prompt": " \x1c"}, {**good, "ref_images": {"a": 1}}, {**good, "ref_images": []}]
    rows += [{**good, "ref_images": ["/a", " ", "b"]}, {**good, "ref_images": ["b", None]}, {**good, "id": "a/b"}, {**good, "id": "..x"}, {**good, "id": "a\x7fb"}, {**good, "id": "-_."}, {**good, "id": " é é "}, {**good, "id": "x" * 100_000}]
    got = normalized(spark, tmp_path, "videoxfun_test", rows)
    assert [got[str(i)].problem for i in range(len(rows))] == [
        None, "not_an_object", "not_an_object", "missing_id", "empty_caption", "references_not_a_list", "reference_count_out_of_range", "empty_reference", "reference_not_absolute",
        "unsafe_id", "unsafe_id", "control_character_in_id", "no_safe_name", "no_safe_name", None,
    ]
    r = got["0"]
    assert (r.source_record_id, r.output_id, r.caption) == ("7", "7", "a\nb")
    assert r.reference_paths == ["/b/c.png", "C:\\x.png"] and r.original_reference_paths == good["ref_images"]
    assert r.sample_key == hashlib.sha256(b"videoxfun_test\0" + b"7").hexdigest() and r.dataset_metadata == {}
    assert (r.width, r.height, r.num_frames, r.fps, r.schema_version, r.task) == (832, 480, 121, 24.0, 1, "r2v")
    assert got["4"].output_id is None and got["4"].source_record_id == "7"


def test_objects_of_records(spark, tmp_path):
    one = lambda p: {"prompt": p, "img_paths": ["i/../j.png"], "class_label": ["x"], "synthesis_flag": True}
    text = f'{{"single_1": {json.dumps(one("old"))}, " ": {json.dumps(one("p"))}, "single_1": {json.dumps(one("new"))}, "b": 3}}'
    got = normalized(spark, tmp_path, "opens2v_open_domain", text)
    assert {k: r.problem for k, r in got.items()} == {"single_1": None, " ": "missing_id", "b": "not_an_object"}
    r = got["single_1"]
    assert r.caption == "new" and r.reference_paths == [f"{tmp_path}/j.png"]
    assert r.dataset_metadata == {"synthesis_flag": "true", "class_label": '["x"]', "schema_group": "single"}


def test_ids_from_file_names(spark, tmp_path):
    names = ["a.tar.mp4", ".hidden", "a/b.mp4", "a..b", ".", "plain", ""]
    got = normalized(spark, tmp_path, "custom64", [{"video_name": n, "caption": "c", "ref_image_paths": ["/r"]} for n in names])
    assert [got[str(i)].source_record_id if got[str(i)].problem is None else got[str(i)].problem for i in range(7)] == ["a.tar", ".hidden", "not_a_plain_filename", "not_a_plain_filename", "not_a_plain_filename", "plain", "missing_id"]
    assert got["1"].output_id == "hidden"


def test_layout_and_policy(spark, tmp_path):
    listed, keyed, broken = (put(tmp_path / f"{i}.json", v) for i, v in enumerate(([], {}, "[1,")))
    assert E.read_external(spark, listed, "custom64").count() == E.read_external(spark, keyed, "opens2v_open_domain").count() == 0
    for path, dataset in ((listed, "opens2v_open_domain"), (keyed, "custom64"), (broken, "custom64")):
        with pytest.raises(ValueError, match="needs JSON"):
            E.read_external(spark, path, dataset)
    with pytest.raises(PermissionError):
        E.read_external(spark, listed, "custom64", PathPolicy([f"{tmp_path}/other"]))
    with pytest.raises(PermissionError):
        E.read_external(spark, f"{tmp_path}/other/../0.json", "custom64", PathPolicy([f"{tmp_path}/other"]))


def test_ids_of_a_set(spark):
    good = lambda i, id_: (str(i), json.dumps({"id": id_, "prompt": "p", "ref_images": ["/r"]}))
    rows = spark.createDataFrame([good(0, "a b"), good(1, "a_b"), good(2, "c"), good(3, "c"), good(4, "d"), ("5", "x")], "source_index string, raw string")
    found = {(r.source_index, r.error_type, r.problem, r.n) for r in E.external_errors(E.normalize_external(rows, "videoxfun_test", "/s/x.json")).collect()}
    assert found == {("5", "record", "not_an_object", 1), ("c", "duplicate_source_id", "c", 2), ("a_b", "output_id_collision", "a_b", 2), ("c", "output_id_collision", "c", 2)}
    none = E.normalize_external(rows.limit(0), "videoxfun_test", "/s/x.json")
    assert E.external_errors(none).count() == 0


def record(**changes):
    row = {"schema_version": 1, "dataset_name": "custom64", "source_json": "/s/x.json", "source_record_id": " a b", "output_id": "a_b", "sample_key": hashlib.sha256(b"custom64\0 a b").hexdigest(), "task": "r2v", "caption": "c"}
    row |= {"reference_paths": ["/r"], "original_reference_paths": ["r"], "width": 832, "height": 480, "num_frames": 121, "fps": 24, "dataset_metadata": {}}
    return {k: v for k, v in (row | changes).items() if v != "gone"}


@pytest.mark.parametrize(
    "changes, problem",
    [
        ({}, None),
        ({"more": 1}, None),
        ({"fps": "24.0"}, None),
        ({"fps": "gone"}, "missing_field"),
        ({"schema_version": "one"}, "schema_version_or_task"),
        ({"dataset_name": "other"}, "unknown_dataset"),
        ({"source_json": "x.json"}, "source_json_not_absolute"),
        ({"output_id": "a b"}, "output_id_not_canonical"),
        ({"output_id": "x"}, "output_id_mismatch"),
        ({"reference_paths": []}, "caption_or_references"),
        ({"reference_paths": ["/r", None]}, "reference_not_absolute"),
        ({"original_reference_paths": ["a", "b"]}, "reference_counts_differ"),
        ({"height": 481}, "geometry_mismatch"),
        ({"sample_key": "x"}, "sample_key_mismatch"),
    ],
)
def test_normalised_records(spark, tmp_path, changes, problem):
    path = put(tmp_path / "m.jsonl", "\n \n" + json.dumps(record(**changes)) + "\n")
    assert [(r.line_number, r.problem) for r in E.check_normalized(spark, path).collect()] == [(3, problem)]
    if problem:
        with pytest.raises(ValueError, match=f"line 3: {problem}"):
            E.load_normalized(spark, path)


def test_normalised_manifests(spark, tmp_path):
    two = record(source_record_id="b", output_id="b", sample_key=hashlib.sha256(b"custom64\0b").hexdigest())
    path = put(tmp_path / "good.jsonl", json.dumps(record()) + "\n" + json.dumps(two) + "\n")
    got = E.load_normalized(spark, path)
    assert {r.output_id: (r.width, r.fps, r.line_number) for r in got.collect()} == {"a_b": (832, 24.0, 1), "b": (832, 24.0, 2)}
    for text, said in (("\n\n", "empty"), (json.dumps(record()) + "\n" + json.dumps(record()), "a_b twice"), (json.dumps(record()) + "\n[1]", "line 2: not_json"), ('{"a":', "line 1: not_json")):
        with pytest.raises(ValueError, match=said):
            E.load_normalized(spark, put(tmp_path / "bad.jsonl", text))


def samples(spark, tmp_path):
    one, two = put(tmp_path / "in/one.JPG", "1" * 10), put(tmp_path / "in/noext", "2" * 20)
    rows = [(3, "r2v", "k/1", "a\ncaption", [one, two], 0.5), (1, "i2i", "k/2", "é", [one], None), (2, "i2i", "x" * 300, None, [], 1.0), (4, "r2v", "", "last", None, 2.0)]
    return spark.createDataFrame(rows, "at int, task string, sample_key string, caption string, reference_paths array<string>, extra double"), one, two


def test_bundles(spark, tmp_path):
    df, one, two = samples(spark, tmp_path)
    root = str(tmp_path / "bundle")
    B.write_bundle(df, root, ["at"])
    got = B.read_bundle(spark, root, content=True).orderBy("line_number").collect()
    assert [(r.at, r.extra, r.line_number) for r in got] == [(1, None, 1), (2, 1.0, 2), (3, 0.5, 3), (4, 2.0, 4)]
    r = got[2]
    assert [os.path.basename(p) for p in r.reference_paths] == ["reference_00.jpg", "reference_01.png"] and r.original_reference_paths == r.reference_exports
    assert [open(p.removeprefix("file://")).read() for p in r.reference_paths] == ["1" * 10, "2" * 20]
    assert r.sample_dir == "r2v_k_1_" + hashlib.sha256(b"k/1").hexdigest()[:12] and got[1].sample_dir.startswith("i2i_" + "x" * 72 + "_") and got[3].sample_dir.startswith("r2v_sample_")
    assert [x.at for x in B.read_bundle(spark, root, tasks=("i2i",)).orderBy("line_number").collect()] == [1, 2]
    assert [x.at for x in B.read_bundle(spark, root, tasks=("r2v",), limit=1).collect()] == [3]
    now = B.Current(spark, root)
    assert {x.task: (x.samples, x.references, x.bytes) for x in now.read("summary").collect()} == {"r2v": (2, 2, 30), "i2i": (2, 1, 10)}
    assert not [n for n in os.listdir(f"{now.base}/tables/references/sample_dir={r.sample_dir}") if n.startswith(".") and not n.endswith(".crc")]
    with pytest.raises(FileExistsError):
        B.write_bundle(df, root, ["at"])
    with pytest.raises(Exception, match="missing"):
        B.write_bundle(df.withColumn("reference_paths", F.array(F.lit(f"{tmp_path}/missing.png"))), root, ["at"], overwrite=True)
    assert B.read_bundle(spark, root).count() == 4
    with pytest.raises(ValueError, match="share the folder"):
        B.write_bundle(df.union(df), root, ["at"], overwrite=True)
    B.write_bundle(df.limit(0), root, ["at"], overwrite=True)
    assert B.read_bundle(spark, root, df.schema).count() == 0


def test_lists_of_samples(spark, tmp_path):
    path = put(tmp_path / "b/selected.jsonl", '{"task": "r2v", "reference_paths": ["../x.png", "/y.png"]}\n\n{"task": "i2i", "reference_paths": ["q"], "reference_exports": ["samples/./q"]}\n{"task": "r2v"}\n')
    rows = B.read_selected(spark, path).orderBy("line_number").collect()
    assert [(r.line_number, r.reference_paths, r.original_reference_paths) for r in rows] == [(1, [f"{tmp_path}/x.png", "/y.png"], ["../x.png", "/y.png"]), (3, [f"{tmp_path}/b/samples/q"], ["q"]), (4, [], [])]
    bad = put(tmp_path / "bad.jsonl", '{"task": "i2i"}\n{"task": "t2v"}\n')
    with pytest.raises(Exception, match="line 2 has no known task: t2v"):
        B.read_selected(spark, bad).collect()
    assert B.read_selected(spark, put(tmp_path / "none.jsonl", "\n")).count() == 0


def test_references_come_last(spark):
    rows = [("a", None, ["1", "2"]), ("a", None, ["1", "2"]), ("b", None, ["3"]), ("c", "empty_caption", ["3"]), ("d", None, []), ("e", None, None), ("f", None, ["1", None]), ("g", None, ["4", "4"])]
    prepared = spark.createDataFrame(rows, "sample_key string, reason string, reference_paths array<string>")
    readable = spark.createDataFrame([("1", True), ("2", True), ("3", False), ("4", None), ("4", True)], "path string, ok boolean")
    got = sorted((r.sample_key, r.reason) for r in finalize(prepared, readable, "phantom_missing_reference").select("sample_key", F.coalesce("reason", F.lit("-")).alias("reason")).collect())
    m = "phantom_missing_reference"
    assert got == [("a", "-"), ("a", "-"), ("b", m), ("c", "empty_caption"), ("d", m), ("e", m), ("f", m), ("g", "-")]
    assert finalize(prepared.limit(0), readable).count() == 0 and {r.reason for r in finalize(prepared, readable.limit(0)).collect()} == {"missing_reference", "empty_caption"}


def manifest_row(task="r2v", **changes):
    row = {"sample_key": "k", "dataset_name": "d", "adapter_name": "a", "source_record_id": "1", "task": task, "target_path": "/t", "reference_paths": ["/r"], "caption": "é", "crop_xyxy": None, "clip_start_frame": None, "clip_end_frame": None, "original_fps": 30.0, "target_width": 832, "target_height": 480}
    if task == "r2v":
        row |= {"target_modality": "video", "target_fps": 24.0, "target_num_frames": 121, "target_source_frame_indices": list(range(5, 126)), "semantic_anchor_target_indices": [0, 60, 120], "semantic_anchor_source_indices": [5, 65, 125]}
    else:
        row |= {"target_modality": "image", "target_fps": 1.0, "target_num_frames": 1, "target_source_frame_indices": [0], "semantic_anchor_target_indices": [0], "semantic_anchor_source_indices": [0]}
    row |= changes
    row["sample_plan_sha256"] = hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return row


MANIFEST = "sample_key string, dataset_name string, adapter_name string, source_record_id string, task string, target_path string, reference_paths array<string>, caption string, crop_xyxy array<double>, clip_start_frame long, clip_end_frame long, original_fps double, target_width int, target_height int, target_modality string, target_fps double, target_num_frames int, target_source_frame_indices array<int>, semantic_anchor_target_indices array<int>, semantic_anchor_source_indices array<int>, sample_plan_sha256 string"

ROWS = [
    (manifest_row(), None),
    (manifest_row("i2i"), None),
    (manifest_row(caption=None, crop_xyxy=[0.5, 1.0, 2.0, 1e20]), None),
    (manifest_row() | {"caption": "e"}, "plan_hash_mismatch"),
    (manifest_row(adapter_name=" "), "blank_field"),
    (manifest_row(target_height=481), "geometry_mismatch"),
    (manifest_row(reference_paths=None), "no_references"),
    (manifest_row(reference_paths=["/r", ""]), "blank_reference"),
    (manifest_row(target_source_frame_indices=None), "invalid_index_list"),
    (manifest_row(semantic_anchor_source_indices=[5, None, 125]), "invalid_index_list"),
    (manifest_row(semantic_anchor_source_indices=[5, 125]), "anchor_lengths_differ"),
    (manifest_row("i2i", target_num_frames=2), "image_not_one_frame"),
    (manifest_row("i2i", target_source_frame_indices=[1]), "image_frames"),
    (manifest_row("i2i", semantic_anchor_target_indices=[1]), "image_anchors"),
    (manifest_row(target_modality="image"), "video_frame_count"),
    (manifest_row(target_fps=None), "video_fps"),
    (manifest_row(target_source_frame_indices=[5, *range(5, 125)]), "frame_list"),
    (manifest_row(semantic_anchor_target_indices=[0, 0, 120]), "anchor_target_order"),
    (manifest_row(semantic_anchor_source_indices=[5, 5, 125]), "anchor_source_order"),
    (manifest_row(semantic_anchor_target_indices=[1, 60, 120]), "anchor_ends"),
    (manifest_row(semantic_anchor_source_indices=[5, 66, 125]), "anchor_sources"),
    (manifest_row(semantic_anchor_target_indices=[], semantic_anchor_source_indices=[]), "anchor_target_order"),
]


def test_scan_without_an_index(spark, tmp_path):
    schema = spark.createDataFrame([], MANIFEST).schema
    lines = [json.dumps(r) for r, _ in ROWS] + ["", "[1]", '{"task": "x"}', '{"task": "r2v"']
    path = put(tmp_path / "m/a.jsonl", "\r\n".join(lines))
    got = {r.row: r.problem for r in scan_manifest(spark, str(tmp_path / "m"), schema, range_bytes=1000).collect()}
    assert [got[i] for i in range(len(got))] == [p for _, p in ROWS] + ["not_an_object", "unknown_task", "not_an_object"]
    compact = {r.row: r.problem for r in scan_manifest(spark, path, schema, compact=True).collect()}
    assert [i for i, p in sorted(compact.items()) if p] == [22, 23, 24]
    with pytest.raises(ValueError, match="row 3: plan_hash_mismatch"):
        scanned_entries(spark, path, schema)
    good = put(tmp_path / "good.jsonl", "\n".join(lines[:3]))
    assert sorted(r.line for r in read_entries(scanned_entries(spark, good, schema).where("row > 0")).collect()) == sorted(lines[1:3])


def test_rows_without_columns_or_with_removed_ones(spark):
    df = spark.createDataFrame([], MANIFEST)
    row = spark.range(1)
    assert row.select(V.row_reason(df.drop("caption")).alias("r")).first().r == "missing_field"
    assert row.select(V.row_reason(df.withColumn("vlm_target_frame_indices", F.lit(1))).alias("r")).first().r == "removed_field"


def test_ratios(spark):
    rows = [("ok", "a", 0.4), ("ok", "b", 0.6), ("neg", "a", -0.5), ("neg", "b", 1.5), ("null", "a", None), ("null", "b", 1.0), ("few", "a", 1.0), ("more", "a", 0.5), ("more", "c", 0.5), ("sum", "a", 0.5), ("sum", "b", 0.6), ("twice", "a", 0.5), ("twice", "a", 0.25), ("twice", "b", 0.25)]
    got = V.ratio_problems(spark.createDataFrame(rows, "c string, name string, ratio double"), spark.createDataFrame([("a",), ("b",), ("b",)], "name string"), ["c"])
    assert {r.c: r.problem for r in got.collect()} == {"ok": None, "neg": "negative", "null": "negative", "few": "names_differ", "more": "names_differ", "sum": "sum_is_not_one", "twice": "repeated_name"}


def test_microbatches(spark):
    rows = [(1, 2, "t", "s", None), (1, 1, "t", "s", None), (2, 1, "t", "s", None), (2, 2, "u", "s", None), (3, 1, "t", "s", None), (3, 2, "t", "z", None), (4, 1, "t", "s", "e1"), (4, 2, "u", "z", None), (5, 1, None, None, None), (6, 1, "t", "s", None), (6, 2, None, "s", None)]
    df = spark.createDataFrame(rows, "b int, o int, task string, shape string, error string")
    got = {r.b: (r.n, r.errors, r.o, r.problem) for r in collated(df, "b", ["o"], ["o"]).collect()}
    assert got == {1: (2, [], [1, 2], None), 2: (2, [], None, "mixed_tasks"), 3: (2, [], None, "mixed_shapes"), 4: (2, ["e1"], None, None), 5: (1, [], [1], None), 6: (2, [], None, "mixed_tasks")}
    assert collated(df.limit(0), "b", ["o"], ["o"]).count() == 0


def test_fingerprints_of_tasks():
    source = discovery.Source("a", "i2i", "p", 0, 5, 0, 5)
    base = discovery.task_fingerprint("i2i", [source], {"manifest_seed": 1, "workers": 2})
    assert base == discovery.task_fingerprint("i2i", [source, discovery.Source("b", "r2v", "q", 1, 5, 0, 5)], {"manifest_seed": 1})
    others = [discovery.task_fingerprint(*a) for a in (("r2v", [source], {"manifest_seed": 1}), ("i2i", [], {"manifest_seed": 1}), ("i2i", [source], {}), ("i2i", [discovery.Source("a", "i2i", "p", 0, 5, 0, 4)], {"manifest_seed": 1}))]
    assert len({base, *others}) == 5


def test_paths_and_names(spark):
    rows = [("/a/./b//../c", "/a/c"), ("/../..", "/"), ("/", "/"), ("/a/" + "x" * 50_000, "/a/" + "x" * 50_000)]
    df = spark.createDataFrame([*rows, (None, None)], "p string, want string")
    assert all(r.got == r.want for r in df.select("want", X.normal_path(F.col("p")).alias("got")).collect())
