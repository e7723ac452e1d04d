"""Adapters from raw annotation rows to the canonical video-reference source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import path_list, resolve_path
from sluice.operators.reject import blank, clip_problem, first_reason

#: Canonical columns every adapter gives, with reason for rows that don't fit.
CANONICAL = ("source_record_id", "caption", "target_path", "reference_paths", "crop_xyxy", "clip_start_frame", "clip_end_frame", "reason")

Adapter = Callable[[DataFrame, "Settings"], DataFrame]
REGISTRY: dict[str, Adapter] = {}


@dataclass(frozen=True)
class Settings:
    data_root: str = ""
    dataset: str = ""
    video_field: str = "video_path"
    caption_field: str = "metadata.video_caption"
    reference_field: str = "cropped_ref_paths"
    require_cross_pair: bool = True
    max_reference_images: int | None = None
    seed: str = "0"


def adapter(name: str) -> Callable[[Adapter], Adapter]:
    def register(f: Adapter) -> Adapter:
        REGISTRY[name] = f
        return f

    return register


def normalize(df: DataFrame, dataset_type: str, settings: Settings) -> DataFrame:
    """Dispatch by dataset type; an unknown type is an error."""
    if dataset_type not in REGISTRY:
        raise ValueError(f"unknown dataset type: {dataset_type}")
    return REGISTRY[dataset_type](df, settings)


def ordered_distinct_paths(paths: Column, root: str) -> Column:
    return F.array_distinct(F.transform(F.filter(paths, lambda p: F.trim(p) != ""), lambda p: resolve_path(root, F.trim(p))))


def seeded_subset(items: Column, k: int, *keys: Column) -> Column:
    """k items by hashed score, in their order."""
    scored = F.transform(items, lambda x, i: F.struct(F.sha2(F.concat_ws("|", *keys, i.cast("string"), x), 256).alias("h"), i.alias("i"), x.alias("x")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, k), lambda s: F.struct(s.i.alias("i"), s.x.alias("x"))))
    return F.when(F.size(items) <= k, items).otherwise(F.transform(chosen, lambda s: s.x))


@adapter("opens2v")
def opens2v(df: DataFrame, s: Settings) -> DataFrame:
    """video_path, text, crop (x0, x1, y0, y1), face_cut (start, end), ref_images."""
    crop, cut = F.col("crop"), F.col("face_cut")
    start, end = F.get(cut, 0), F.get(cut, 1)
    missing = F.col("video_path").isNull() | F.col("text").isNull() | crop.isNull() | cut.isNull() | F.col("ref_images").isNull()
    finite = F.forall(crop, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    extent = (F.get(crop, 1) > F.get(crop, 0)) & (F.get(crop, 3) > F.get(crop, 2))
    reason = first_reason(
        [
            ("r2v_schema_mismatch", missing),
            ("empty_caption", blank("text")),
            ("invalid_crop", (F.size(crop) != 4) | ~F.coalesce(finite & extent, F.lit(False))),
            ("invalid_clip", F.size(cut) != 2),
            ("invalid_face_cut", clip_problem(start, end)),
        ]
    )
    return df.select(
        F.col("source_record_id").cast("string"),
        F.trim("text").alias("caption"),
        resolve_path(s.data_root, F.col("video_path")).alias("target_path"),
        F.transform("ref_images", lambda p: resolve_path(s.data_root, F.trim(p))).alias("reference_paths"),
        F.array(*[F.get(crop, i).cast("double") for i in (0, 2, 1, 3)]).alias("crop_xyxy"),
        start.cast("long").alias("clip_start_frame"),
        end.cast("long").alias("clip_end_frame"),
        reason.alias("reason"),
    )


@adapter("phantom")
def phantom(df: DataFrame, s: Settings) -> DataFrame:
    """Configurable dotted fields, an optional cross pair, ordered distinct references."""
    paths = ordered_distinct_paths(F.col(s.reference_field), s.data_root)
    if s.max_reference_images:
        paths = seeded_subset(paths, s.max_reference_images, F.lit(s.dataset), F.col("source_record_id").cast("string"), F.lit(s.seed))
    checks = [("phantom_empty_caption", blank(s.caption_field)), ("phantom_missing_target", blank(s.video_field))]
    if s.require_cross_pair:
        pair = F.col("cross_pair") if "cross_pair" in df.columns else F.lit(None)
        checks.append(("phantom_missing_cross_pair", pair.isNull()))
    checks.append(("phantom_missing_reference", F.coalesce(F.size(paths) <= 0, F.lit(True))))
    return df.select(
        F.col("source_record_id").cast("string"),
        F.trim(F.col(s.caption_field)).alias("caption"),
        resolve_path(s.data_root, F.col(s.video_field)).alias("target_path"),
        paths.alias("reference_paths"),
        F.lit(None).cast("array<double>").alias("crop_xyxy"),
        F.lit(None).cast("long").alias("clip_start_frame"),
        F.lit(None).cast("long").alias("clip_end_frame"),
        first_reason(checks).alias("reason"),
    )


def image_pairs(df: DataFrame, s: Settings, target: str = "image", references: str = "edit_image", caption: str = "prompt") -> DataFrame:
    """Image-to-image rows: configured field names; references as a list or delimited string."""
    is_list = dict(df.dtypes)[references].startswith("array")
    paths = F.transform(F.col(references), lambda p: F.trim(p)) if is_list else path_list(F.col(references))
    missing = F.col(target).isNull() | F.col(references).isNull() | F.col(caption).isNull()
    reason = first_reason([("i2i_schema_mismatch", missing), ("empty_caption", blank(caption)), ("missing_reference", F.size(paths) <= 0)])
    return df.select(
        F.col("source_record_id").cast("string"),
        F.trim(F.col(caption)).alias("caption"),
        resolve_path(s.data_root, F.col(target)).alias("target_path"),
        F.transform(paths, lambda p: resolve_path(s.data_root, p)).alias("reference_paths"),
        F.lit(None).cast("array<double>").alias("crop_xyxy"),
        F.lit(0).cast("long").alias("clip_start_frame"),
        F.lit(1).cast("long").alias("clip_end_frame"),
        reason.alias("reason"),
    )


adapter("i2i")(image_pairs)


def role_columns(columns: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Roles of dataset columns: aliases first, then overrides."""
    aliases = {"media_path": "video", "ref_media_path": "reference_video"}
    out = {aliases.get(c, c): c for c in columns}
    return out | (overrides or {})


def rewrite_keys(key: Column, replacements: list[tuple[str, str]]) -> Column:
    """Ordered substring replacements."""
    for old, new in replacements:
        key = F.replace(key, F.lit(old), F.lit(new))
    return key
