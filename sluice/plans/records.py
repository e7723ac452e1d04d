"""Records from annotation to manifest, and validation of what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.validate import manifest_reason
from sluice.plans.catalog import Tables, query
from sluice.sources.adapters import Settings, normalize
from sluice.sources.prepare import PLAN, prepare_r2v


def prepared(t: Tables) -> DataFrame:
    """Parts as annotations of videos, whose headers are the suppliers'."""
    key = F.col("p_partkey")
    first = (key * 7 % 90).cast("long")
    rows = t.part.select(
        key.cast("string").alias("source_record_id"),
        F.concat(F.lit("v"), key * 3 % 150, F.lit(".mp4")).alias("video_path"),
        F.when(key % 23 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("text"),
        F.array(F.lit(10.0), F.lit(20.0) + F.col("p_size"), F.lit(5.0), F.lit(6.0) + F.col("p_size") % 7).alias("crop"),
        F.array(first, first + 100 + key % 300).alias("face_cut"),
        F.transform(F.sequence(F.lit(1), (key % 6).cast("int") + 1), lambda i: F.concat(F.lit("r"), i, F.lit(".png"))).alias("ref_images"),
    )
    s = F.col("s_suppkey")
    headers = t.supplier.select(F.concat(F.lit("/m/v"), s, F.lit(".mp4")).alias("path"), (18 + s % 25).cast("double").alias("fps"), F.when(s % 17 == 0, 0).otherwise(250 + s * 13 % 500).cast("long").alias("frame_count"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    return prepare_r2v(normalize(rows, "opens2v", Settings(data_root="/m")), headers, "seed")


_PREPARED = """
WITH p AS (SELECT p_partkey AS k, '/m/v' || (p_partkey * 3 % 150) || '.mp4' AS path, trim(CASE WHEN p_partkey % 23 = 0 THEN '  ' ELSE p_name END) AS caption, p_size, p_partkey * 7 % 90 AS a, p_partkey * 7 % 90 + 100 + p_partkey % 300 AS b, p_partkey % 6 + 1 AS refs FROM part),
h AS (SELECT '/m/v' || s_suppkey || '.mp4' AS path, (18 + s_suppkey % 25)::DOUBLE AS fps, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 250 + s_suppkey * 13 % 500 END AS n FROM supplier),
m AS (SELECT *, b - 1 - floor(120 * (fps / 24.0))::BIGINT AS latest, ('0x' || left(sha256('seed:' || k || ':' || path), 13))::BIGINT / 4503599627370496.0 AS u FROM p LEFT JOIN h USING (path)),
w AS (SELECT *, a + floor(u * (latest - a + 1))::BIGINT AS wanted FROM m),
c AS (SELECT *, list_filter(list_distinct([wanted, wanted - 1, wanted + 1, wanted - 2, wanted + 2, a, a + 1, a + 2, latest, latest - 1, latest - 2]), lambda s: s >= a AND s <= latest AND round_even(s + 120 * fps / 24.0, 0) < b) AS good,
  list_sort([wanted, wanted - 1, wanted + 1, wanted - 2, wanted + 2]) AS near FROM w),
r AS (SELECT *, CASE WHEN caption = '' THEN 'empty_caption' WHEN fps IS NULL THEN 'missing_target' WHEN n = 0 THEN 'invalid_media_header' WHEN b > n THEN 'invalid_clip'
  WHEN 20 + p_size > 64 THEN 'invalid_crop' WHEN refs > 4 THEN 'reference_count_out_of_range' WHEN fps < 24 AND latest >= a THEN 'source_fps_too_low_for_unique_sampling' WHEN latest < a OR len(good) = 0 THEN 'insufficient_frames' END AS reason FROM c),
"""


@query(
    _PREPARED
    + """s AS (SELECT *, list_filter([wanted, wanted - 1, wanted + 1, wanted - 2, wanted + 2, a, a + 1, a + 2, latest, latest - 1, latest - 2], lambda s: list_contains(good, s))[1] AS start FROM r)
SELECT k::VARCHAR AS source_record_id, reason, CASE WHEN reason IS NULL THEN start END AS first_frame, CASE WHEN reason IS NULL THEN round_even(start + 120 * fps / 24.0, 0)::BIGINT END AS last_frame,
  CASE WHEN reason IS NULL THEN list_sum(list_transform(range(121), lambda i: round_even(start + i * fps / 24.0, 0)::BIGINT))::BIGINT END AS frames_sum,
  CASE WHEN reason IS NULL THEN list_sum(list_transform(range(12), lambda i: round_even(start + round_even(i * 120 / 11.0, 0) * fps / 24.0, 0)::BIGINT))::BIGINT END AS anchors_sum FROM s"""
)
def r2v_preparation(t: Tables) -> DataFrame:
    """Annotations with their headers to frame plans and anchors, or the reason against them."""
    rows = prepared(t)
    when = lambda c: F.when(F.col("reason").isNull(), c)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x)
    plan = F.col("target_source_frame_indices")
    return rows.select("source_record_id", "reason", when(F.get(plan, 0)).alias("first_frame"), when(F.get(plan, 120)).alias("last_frame"), when(total(plan)).alias("frames_sum"), when(total("semantic_anchor_source_indices")).alias("anchors_sum"))


@query(
    _PREPARED
    + """v AS (SELECT k, CASE k % 8 WHEN 0 THEN 'plan_hash_mismatch' WHEN 1 THEN 'missing_field' WHEN 2 THEN 'unknown_task' WHEN 3 THEN 'plan_hash_mismatch' WHEN 4 THEN 'plan_hash_mismatch' END AS problem FROM r WHERE reason IS NULL)
SELECT k::VARCHAR AS source_record_id, problem FROM v"""
)
def manifest_validation(t: Tables) -> DataFrame:
    """Prepared manifest rows, some changed after they were finished (caption, key, task, a frame, the clip), under full validation."""
    rows = prepared(t).where("reason is null").drop("reason")
    kind = F.col("source_record_id").cast("long") % 8
    frames = F.col("target_source_frame_indices")
    changed = rows.withColumns(
        {
            "caption": F.when(kind == 0, F.concat("caption", F.lit("é"))).otherwise(F.col("caption")),
            "sample_key": F.when(kind == 1, F.lit(" ")).otherwise(F.col("sample_key")),
            "task": F.when(kind == 2, F.lit("x2v")).otherwise(F.col("task")),
            "target_source_frame_indices": F.when(kind == 3, F.concat(F.slice(frames, 1, 120), F.array(F.get(frames, 120) + 1))).otherwise(frames),
            "clip_end_frame": F.when(kind == 4, F.col("clip_end_frame") - 1).otherwise(F.col("clip_end_frame")),
        }
    )
    return changed.select("source_record_id", manifest_reason(changed, list(PLAN)).alias("problem"))
