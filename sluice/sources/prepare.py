"""Video-reference records end to end: normalised rows and media headers to manifest rows with a frame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.identity import content_key
from sluice.operators.reject import crop_problem, first_reason
from sluice.operators.sampling import unit
from sluice.operators.temporal import candidate_starts, resample_plan, uniform_indices
from sluice.operators.validate import ANCHORS, FPS, FRAMES, HEIGHT, WIDTH
from sluice.session import dealt

#: What a record's key and its plan's hash are made of.
IDENTITY = ("task", "target_path", "reference_paths", "caption", "clip_start_frame", "clip_end_frame")
PLAN = (*IDENTITY, "sample_key", "source_record_id", "target_source_frame_indices", "semantic_anchor_target_indices", "semantic_anchor_source_indices", "crop_xyxy", "source_fps", "target_width", "target_height")


def prepare_r2v(rows: DataFrame, headers: DataFrame, seed: str = "0") -> DataFrame:
    """Manifest rows of normalised ``rows`` (the adapters' columns), and the first reason against those that are rejected.

    headers: path, fps, frame_count, width, height; a video without a header, or with an incomplete one, is rejected. A
    missing clip is the whole video. The plan has FRAMES frames at FPS: it begins at a seeded place of the clip, or, if that does not
    work out after rounding, at the first candidate near it, near the clip's start or near its last possible start. Rows are joined
    with headers by path and dealt over tasks by their number: plans and hashes are heavy per row, and few videos may have all rows."""
    met = dealt(rows.join(headers.withColumnRenamed("path", "target_path"), "target_path", "left"), rows)
    good_header = F.coalesce((F.col("fps") > 0) & (F.col("fps") < float("inf")) & (F.col("frame_count") > 0) & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    met = met.withColumn("clip_start_frame", F.coalesce("clip_start_frame", F.lit(0))).withColumn("clip_end_frame", F.coalesce("clip_end_frame", F.col("frame_count").cast("long")))
    start, end = F.col("clip_start_frame"), F.col("clip_end_frame")
    step = F.col("fps") / FPS
    latest = (end - 1 - F.floor((FRAMES - 1) * step)).cast("int")
    met = met.withColumn("_latest", F.when(good_header, latest))
    free = F.col("_latest") - start + 1
    wanted = (start + F.floor(unit(seed, "source_record_id", "target_path") * free)).cast("int")
    starts = F.when(good_header & (free > 0), candidate_starts(wanted, start.cast("int"), F.col("_latest")))
    # at the target's rate or above no frame comes twice; of slower sources only starts whose first and last frame lie far enough
    # apart for as many frames need whole plans to tell
    slow = F.col("fps") < FPS
    last = lambda s: F.rint(s + (FRAMES - 1) * F.col("fps") / F.lit(FPS))
    unique = lambda s: (last(s) - s >= FRAMES - 1) & (F.size(F.array_distinct(resample_plan(s, F.col("fps"), FPS, FRAMES))) == FRAMES)
    met = met.withColumn("_starts", starts)
    met = met.withColumn("_unique", F.when(slow, F.filter("_starts", unique)).otherwise(F.col("_starts")))
    met = met.withColumn("_start", F.get(F.filter("_unique", lambda s: last(s) < end), 0))
    met = met.withColumn("_plan", F.when(F.col("_start").isNotNull(), resample_plan(F.col("_start"), F.col("fps"), FPS, FRAMES)))
    crop = F.col("crop_xyxy")
    bad_crop = F.coalesce(crop_problem(crop, F.col("width"), F.col("height")), F.lit(False))
    reason = first_reason(
        [
            ("missing_target", F.col("fps").isNull()),
            ("invalid_media_header", ~good_header),
            ("invalid_clip", ~((start >= 0) & (start < end) & (end <= F.col("frame_count")))),
            ("invalid_crop", bad_crop),
            ("reference_count_out_of_range", ~F.coalesce(F.size("reference_paths").between(1, 4), F.lit(False))),
            ("source_fps_too_low_for_unique_sampling", slow & (F.size("_unique") == 0)),
            ("insufficient_frames", F.col("_start").isNull()),
        ]
    )
    met = met.withColumn("reason", F.coalesce("reason", reason)).withColumn("task", F.lit("r2v"))
    frames, anchors = F.col("_plan"), uniform_indices(F.lit(FRAMES), ANCHORS)
    made = met.withColumns(
        {
            "target_source_frame_indices": frames,
            "semantic_anchor_target_indices": F.when(frames.isNotNull(), anchors),
            "semantic_anchor_source_indices": F.transform(F.when(frames.isNotNull(), anchors), lambda i: F.get(frames, i)),
            "source_fps": F.col("fps").cast("double"),
            "target_width": F.lit(WIDTH),
            "target_height": F.lit(HEIGHT),
        }
    )
    made = made.withColumn("sample_key", content_key(made, *IDENTITY))
    return made.withColumn("sample_plan_sha256", content_key(made, *PLAN)).select(*PLAN, "sample_plan_sha256", "reason")


def finalize(prepared: DataFrame, readable: DataFrame, reason: str = "missing_reference") -> DataFrame:
    """The second stage: rows that stood all other checks lose to ``reason`` if one of their references is not among ``readable``
    (path, ok), or not ok there. Only references of rows without a reason are looked up.

    The lookup is by distinct (sample_key, path): a key names its references, so repeated rows are looked up once. A row without
    references is rejected, too; a null reference is never readable."""
    wanted = prepared.where("reason is null").groupBy("sample_key").agg(F.first("reference_paths").alias("_refs"))
    each = wanted.select("sample_key", F.explode_outer(F.array_distinct("_refs")).alias("path"))
    good = readable.groupBy("path").agg(F.bool_or("ok").alias("_ok"))
    bad = each.join(good, "path", "left").where(~F.coalesce("_ok", F.lit(False))).select("sample_key").distinct().withColumn("_bad", F.lit(True))
    out = prepared.join(bad, "sample_key", "left")
    late = F.when(F.col("reason").isNull() & F.coalesce("_bad", F.lit(False)), F.lit(reason))
    return out.withColumn("reason", F.coalesce("reason", late)).select(*prepared.columns)
