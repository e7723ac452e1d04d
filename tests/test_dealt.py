"""Work that is heavy per row is dealt over tasks by rows, however few bytes they have."""

import itertools
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.functions.text import WHITE, stripped
from sluice.operators import visibility as Y
from sluice.operators.temporal import resample_plan
from sluice.session import dealt, shared_dir
from sluice.sources import external as E
from sluice.sources.adapters import Settings, normalize
from sluice.sources.prepare import finalize, prepare_r2v


def tasks(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def records(spark, n):
    raw = json.dumps({"id": "x", "prompt": "p", "ref_images": ["/r.png"]})
    return spark.range(n).coalesce(1).select(F.col("id").cast("string").alias("source_index"), F.replace(F.lit(raw), F.lit('"x"'), F.concat(F.lit('"'), F.col("id") % 15_000, F.lit('"'))).alias("raw"))


def test_rows_are_dealt_by_number(spark):
    got = tasks(dealt(spark.range(100).coalesce(1), rows=10))
    assert len(got) == 10 and sum(got) == 100
    assert tasks(dealt(spark.range(0))) == [] and sum(tasks(dealt(spark.range(7)))) == 7


def test_records_of_a_set_are_checked_once(spark):
    """errors read the checked rows, and no filter repeats the checks."""
    found = E.external_errors(E.normalize_external(records(spark, 20_000), "videoxfun_test", "/s.json"))
    assert "from_json" not in plan(found)
    assert found.groupBy("error_type").count().orderBy("error_type").collect() == [("duplicate_source_id", 5000), ("output_id_collision", 5000)]


def test_records_of_a_small_file_make_several_tasks(spark):
    """the manifest is made from rows that several tasks checked."""
    made = E.normalize_external(records(spark, 20_000), "videoxfun_test", "/s.json")
    files = {f for f in made.inputFiles()}
    assert len(files) == 3 and made.where("problem is null").count() == 20_000


def test_lines_are_stripped_at_their_ends_only(spark, tmp_path):
    """no pattern is tried at every character of a manifest's lines, and records are not kept before they are checked."""
    kept = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("sluice/raw-*")}
    before = kept()
    made = E.normalize_external(records(spark, 20), "videoxfun_test", "/s.json").where("problem is null")
    assert kept() == before
    made.select(F.to_json(F.struct(*made.columns[2:])).alias("value")).write.text(str(tmp_path / "m"))
    checked = E.check_normalized(spark, str(tmp_path / "m"))
    assert "regexp_replace(raw" not in plan(checked) and checked.where("problem is null").count() == 20


def test_white_space_is_that_of_the_pattern(spark):
    codes = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    sides = codes.select(F.concat("c", "c", F.lit("a"), "c", F.lit("b"), "c").alias("t")).unionAll(codes)
    assert sides.where(~stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))).count() == 0
    assert codes.where((F.col("c") != "") & (stripped(F.col("c")) == "")).count() == len(WHITE)


def test_frames_of_few_batches_make_several_tasks(spark):
    """a frame's 320 rows are made behind the shuffle by batch."""
    tokens = spark.range(1000).select((F.col("id") % 600).alias("b"), F.col("id").alias("p"), F.lit(True).alias("valid"), F.lit(False).alias("image"))
    frames = tokens.select("b").distinct().withColumn("frames", F.lit(1))
    got = Y.teacher_ranges(tokens, frames, "b", "p", "valid", "image").where("part <> 'prefix'")
    assert sum(tasks(got)) == 600 * 320 and len(tasks(got)) >= 3


def test_lists_behind_a_prefix_are_merged(spark):
    rows = spark.createDataFrame([(m, s, s + n) for m, d, n in itertools.product((0, 1, 5), (0, 1, 7), (1, 4)) for s in [m + d]], "m long, s long, e long")
    rest = Y.span(F.col("e") + 3, F.col("e") + 5)
    got = rows.select("m", "s", Y.behind_prefix(F.col("m"), F.col("s"), F.col("e"), rest).alias("x"), Y.merged(F.array(Y.span(F.lit(0), F.col("m")), Y.span(F.col("s"), F.col("e")), rest)).alias("y"))
    assert all(r.x == r.y for r in got.collect())


@pytest.fixture()
def of_one_video(spark):
    """20,000 annotations of one video in one small file."""
    refs = F.array(F.lit("r1.png"))
    rows = spark.range(20_000).coalesce(1).select(F.col("id").cast("string").alias("source_record_id"), F.lit("v.mp4").alias("video_path"), F.lit("t").alias("text"), F.array(*[F.lit(x) for x in (1.0, 20.0, 1.0, 20.0)]).alias("crop"), F.array(F.lit(0).cast("long"), F.lit(200).cast("long")).alias("face_cut"), refs.alias("ref_images"))
    headers = spark.createDataFrame([("/m/v.mp4", 24.0, 300, 64, 48)], "path string, fps double, frame_count long, width int, height int")
    return prepare_r2v(normalize(rows, "opens2v", Settings(data_root="/m")), headers, "s")


def test_records_of_one_video_make_several_tasks(of_one_video):
    """plans are laid behind the join with headers."""
    got = tasks(of_one_video.select("source_record_id", "reason"))
    assert len(got) == 3 and sum(got) == 20_000


def test_slow_sources_lay_whole_plans_only_where_all_frames_can_differ(spark):
    """a start whose first and last frame lie too near is out without a plan; what is found equals whole plans for every start."""
    headers = spark.range(1, 400).select(F.format_string("/m/v%d.mp4", "id").alias("path"), (F.col("id") % 400 / 16.0 + 0.5).alias("fps"), F.lit(400).alias("frame_count"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    headers = headers.withColumn("fps", F.when(F.col("path") < "/m/v2", 24 - 1 / (F.length("path") * 100.0)).otherwise(F.col("fps")))
    rows = headers.select(F.substring_index("path", "/", -1).alias("video_path"), F.col("path").alias("source_record_id"), F.lit("t").alias("text"), F.array(*[F.lit(x) for x in (1.0, 20.0, 1.0, 20.0)]).alias("crop"), F.array(F.lit(3).cast("long"), F.lit(300).cast("long")).alias("face_cut"), F.array(F.lit("r.png")).alias("ref_images"))
    made = prepare_r2v(normalize(rows, "opens2v", Settings(data_root="/m")), headers, "s").join(headers.withColumnRenamed("path", "target_path"), "target_path").where("fps < 24")
    frames = F.col("target_source_frame_indices")
    can = F.exists(F.sequence(F.lit(3), F.lit(300)), lambda s: (F.size(F.array_distinct(resample_plan(s, F.col("fps"), 24.0, 121))) == 121))
    got = made.groupBy(F.col("reason").alias("why"), can.alias("can"), (F.size(F.array_distinct(frames)) == 121).alias("all")).count().collect()
    assert {(r.why, r.can, r.all) for r in got} == {(None, True, True), ("source_fps_too_low_for_unique_sampling", False, None)}
    assert ">= 120.0) AND (size(array_distinct(" in plan(made)


def test_late_checks_read_records_of_several_tasks(spark, of_one_video):
    """F6."""
    some = of_one_video.drop("sample_plan_sha256")
    assert len(tasks(some)) == 3
    readable = spark.createDataFrame([("/m/r1.png", False)], "path string, ok boolean")
    few = some.where(F.col("source_record_id") < 20)
    assert [r.reason for r in finalize(few, readable).collect()] == ["missing_reference"] * 20
