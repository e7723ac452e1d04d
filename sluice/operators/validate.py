"""Validation of finished manifest rows, row by row and over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import is_absolute, safe_id
from sluice.operators.identity import content_key
from sluice.operators.reject import first_reason, strictly_increasing
from sluice.operators.temporal import uniform_indices

#: Geometry of video samples.
WIDTH, HEIGHT, FRAMES, FPS, ANCHORS = 832, 480, 121, 24.0, 12
FORBIDDEN = ("latent_path", "embedding_path")


def manifest_reason(df: DataFrame, plan_fields: list[str], frames: int = FRAMES) -> Column:
    """Why a manifest row is not valid; null if it is.

    Checks in order: blank texts, task, reference count, hash over ``plan_fields``, geometry,
    frame list (length, order, range), anchors (uniform targets, matching sources)."""
    idx, at, source = F.col("target_source_frame_indices"), F.col("semantic_anchor_target_indices"), F.col("semantic_anchor_source_indices")
    blank_text = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    checks = [
        ("missing_field", blank_text("sample_key") | blank_text("target_path") | blank_text("source_record_id")),
        ("empty_caption", blank_text("caption")),
        ("unknown_task", ~F.col("task").isin("i2i", "r2v")),
        ("reference_count_out_of_range", ~F.size("reference_paths").between(1, 4)),
        ("plan_hash_mismatch", F.col("sample_plan_sha256") != content_key(df, *plan_fields)),
        ("geometry_mismatch", (F.col("target_width") != WIDTH) | (F.col("target_height") != HEIGHT)),
        ("frame_list_length", F.size(idx) != frames),
        ("frame_list_order", ~strictly_increasing(idx)),
        ("frame_list_range", (F.array_min(idx) < F.col("clip_start_frame")) | (F.array_max(idx) >= F.col("clip_end_frame"))),
        ("anchor_targets", at != uniform_indices(F.lit(frames), ANCHORS)),
        ("anchor_sources", source != F.transform(at, lambda i: F.get(idx, i))),
    ]
    return first_reason(checks)


def forbidden_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in FORBIDDEN]


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def colliding_ids(df: DataFrame, record_id: str, output_id: str) -> DataFrame:
    """Output ids that several records would take, each with its first records."""
    each = df.select(record_id, output_id).distinct()
    return each.groupBy(output_id).agg(F.count(F.lit(1)).alias("n"), F.min(record_id).alias("first"), F.max(record_id).alias("last")).where("n > 1")


def selection_reason(caption: Column, references: Column, target: Column, longest: int) -> Column:
    """Why a row cannot be selected."""
    return first_reason(
        [
            ("empty_caption", F.coalesce(F.trim(caption) == "", F.lit(True))),
            ("caption_too_long", F.length(caption) > longest),
            ("reference_count_out_of_range", ~F.coalesce(F.size(references).between(1, 4), F.lit(False))),
            ("reference_aliases_target", F.array_contains(references, target)),
        ]
    )


def check_ratios(ratios: dict[str, float], names: list[str]) -> None:
    """Ratios are not negative, sum to one, and name exactly the datasets."""
    if set(ratios) != set(names):
        raise ValueError("ratio keys must be the dataset names")
    if any(r < 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must not be negative and must sum to 1")


def external_reason(text: Column, references: Column, key: Column, name: Column) -> Column:
    """Why a record from outside is not taken: text, one to four references, absolute paths, id, file name."""
    return first_reason(
        [
            ("missing_text", F.coalesce(F.trim(text) == "", F.lit(True))),
            ("reference_count_out_of_range", ~F.coalesce(F.size(references).between(1, 4), F.lit(False))),
            ("path_not_absolute", ~F.forall(references, is_absolute)),
            ("unsafe_id", safe_id(key).isNull()),
            ("not_a_plain_filename", name.rlike(r"[/\\]")),
        ]
    )


def bucket_fits(width: Column, height: Column, frames: Column) -> Column:
    """Whether a bucket suits patches of 32 x 32 pixels and frames in eights after the first."""
    return (width % 32 == 0) & (height % 32 == 0) & (frames % 8 == 1)


def span_reason(start: Column, end: Column, frames: int = FRAMES) -> Column:
    return F.when(end - start < frames, F.lit(f"insufficient_face_cut_span_for_{frames}"))


#: Reasons that probing gives, by what went wrong.
PROBE_REASONS = {"timeout": "video_probe_timeout", "crash": "video_probe_worker_crash", "closed": "probe_pool_closed", "invalid": "invalid_image", "missing_media": "missing_target"}


def probe_reason(status: Column) -> Column:
    """The reason for a probe's status; null stays null, an unknown status names itself."""
    known = F.create_map(*[F.lit(x) for pair in PROBE_REASONS.items() for x in pair])
    return F.coalesce(F.element_at(known, status), status)


def ratio_problems(ratios: DataFrame, names: DataFrame, by: list[str], tolerance: float = 1e-8) -> DataFrame:
    """What is wrong with each configuration's ratios (``by``, name, ratio), a row each: a ratio that is negative or null, a name that comes
    twice, names that are not exactly those of ``names``, a sum other than one; null if nothing is."""
    known = names.select("name").distinct()
    n = known.count()
    met = ratios.join(known.withColumn("_known", F.lit(True)), "name", "left")
    each = met.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("_n"), F.sum("ratio").alias("_sum"), F.bool_or(F.coalesce(F.col("ratio") < 0, F.lit(True))).alias("_negative"), F.first("_known").alias("_known"))
    total = each.groupBy(*by).agg(F.sum("_sum").alias("s"), F.bool_or("_negative").alias("negative"), F.max("_n").alias("most"), F.count(F.lit(1)).alias("n"), F.count("_known").alias("known"))
    problem = first_reason(
        [
            ("negative", F.col("negative")),
            ("repeated_name", F.col("most") > 1),
            ("names_differ", (F.col("n") != n) | (F.col("known") != n)),
            ("sum_is_not_one", F.abs(F.col("s") - 1) > tolerance),
        ]
    )
    return total.select(*by, problem.alias("problem"))


#: Fields of a manifest row, those that must be filled texts, and fields that rows no longer have.
MANIFEST_FIELDS = (
    "sample_key", "sample_plan_sha256", "dataset_name", "adapter_name", "source_record_id", "task", "target_modality", "target_path", "reference_paths", "caption", "crop_xyxy",
    "clip_start_frame", "clip_end_frame", "original_fps", "target_fps", "target_num_frames", "target_width", "target_height", "target_source_frame_indices",
    "semantic_anchor_target_indices", "semantic_anchor_source_indices",
)
FILLED_FIELDS = ("sample_key", "dataset_name", "adapter_name", "source_record_id", "target_path", "task")
REMOVED_FIELDS = ("vlm_target_frame_indices", "vlm_source_frame_indices")
IMAGE_FPS = 1.0


def row_reason(df: DataFrame, plan: list[str] | None = None) -> Column:
    """Why a manifest row of either task is not valid; null if it is. The hash is over ``plan`` (by default every column but the hash).

    Checks in order: all columns there, none of the removed ones, filled texts, task, hash, geometry, references, index lists (there,
    without nulls, anchors as long as each other); then an image is one frame [0] at one frame a second with the anchor [0]; a video has FRAMES
    frames at FPS in strictly ascending order, and anchors in strictly ascending order from the first to the last target frame whose
    sources are the plan's. A null list, number or text fails its check."""
    if not set(MANIFEST_FIELDS) <= set(df.columns):
        return F.lit("missing_field")
    if set(REMOVED_FIELDS) & set(df.columns):
        return F.lit("removed_field")
    plan = plan or [c for c in df.columns if c != "sample_plan_sha256"]
    idx, at, source = F.col("target_source_frame_indices"), F.col("semantic_anchor_target_indices"), F.col("semantic_anchor_source_indices")
    is_ = lambda ok: ~F.coalesce(ok, F.lit(False))
    image, video = F.col("task") == "i2i", F.col("task") == "r2v"
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    filled = ~blank(FILLED_FIELDS[0])
    for c in FILLED_FIELDS[1:]:
        filled = filled & ~blank(c)
    first = F.array(F.lit(0))
    same = lambda a, b: F.coalesce(a.cast("array<bigint>") == b.cast("array<bigint>"), F.lit(False))
    listed = lambda a: F.coalesce(F.forall(a, lambda i: i.isNotNull()), F.lit(False))
    return first_reason(
        [
            ("blank_field", ~filled),
            ("unknown_task", ~(image | video)),
            ("plan_hash_mismatch", is_(F.col("sample_plan_sha256") == content_key(df, *plan))),
            ("geometry_mismatch", is_((F.col("target_width") == WIDTH) & (F.col("target_height") == HEIGHT))),
            ("no_references", is_(F.size("reference_paths") > 0)),
            ("blank_reference", is_(F.forall("reference_paths", lambda x: F.coalesce(x != "", F.lit(False))))),
            ("invalid_index_list", ~(listed(idx) & listed(at) & listed(source))),
            ("anchor_lengths_differ", F.size(at) != F.size(source)),
            ("image_not_one_frame", image & is_((F.col("target_modality") == "image") & (F.col("target_num_frames") == 1))),
            ("image_frames", image & (is_(F.col("target_fps") == IMAGE_FPS) | ~same(idx, first))),
            ("image_anchors", image & ~(same(at, first) & same(source, first))),
            ("video_frame_count", video & is_((F.col("target_modality") == "video") & (F.col("target_num_frames") == FRAMES))),
            ("video_fps", video & is_(F.col("target_fps") == FPS)),
            ("frame_list", video & ((F.size(idx) != FRAMES) | is_(strictly_increasing(idx)))),
            ("anchor_target_order", video & is_(strictly_increasing(at))),
            ("anchor_source_order", video & is_(strictly_increasing(source))),
            ("anchor_ends", video & ((F.get(at, 0) != 0) | (F.element_at(at, -1) != FRAMES - 1))),
            ("anchor_sources", video & ~same(source, F.transform(at, lambda i: F.get(idx, i.cast("int"))))),
        ]
    )
