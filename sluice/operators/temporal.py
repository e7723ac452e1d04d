"""Frame plans, tiles, masks and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def indices(n: Column | int) -> Column:
    """0..n-1, empty for n <= 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def resample_plan(start: Column, source_fps: Column, target_fps: float, n: int) -> Column:
    """Source frames of n target frames: half-to-even of start + i * source / target."""
    return F.transform(indices(n), lambda i: F.rint(start + i * source_fps / F.lit(float(target_fps))).cast("int"))


def plan_reason(plan: Column, clip_end: Column) -> Column:
    """Null for a good plan; else why it fails: repeated frames first, then frames beyond the clip."""
    repeats = F.size(F.array_distinct(plan)) < F.size(plan)
    return F.when(repeats, F.lit("source_fps_too_low_for_unique_sampling")).when(F.array_max(plan) >= clip_end, F.lit("insufficient_frames"))


def candidate_starts(preferred: Column, clip_start: Column, max_start: Column) -> Column:
    """Starts to try: the preferred, the first and the last, each with small offsets."""
    offsets = F.array(*[F.lit(o) for o in (0, -1, 1, -2, 2)])
    tried = F.flatten(F.transform(F.array(preferred, clip_start, max_start), lambda s: F.transform(offsets, lambda o: (s + o).cast("int"))))
    return F.array_distinct(F.filter(tried, lambda s: (s >= clip_start) & (s <= max_start)))


def uniform_indices(n: Column, k: int) -> Column:
    """k indices over 0..n-1, ends included, half to even; k = 1 gives 0."""
    if k == 1:
        return F.array(F.lit(0))
    return F.transform(indices(k), lambda i: F.rint(i * (n - 1) / F.lit(float(k - 1))).cast("int"))


def aligned_subsample(n: Column, step: int) -> Column:
    """0, then every ``step``-th of 1..n-1."""
    rest = F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), rest)


def latent_frames(frames: Column, factor: int = 8) -> Column:
    return F.floor((frames - 1) / factor) + 1


def tiles_by_size(n: Column, size: int, overlap: int) -> Column:
    """[start, end) tiles with the ramps they share; one tile if n <= size."""
    amount = F.floor((n + size - 2 * overlap - 1) / (size - overlap)).cast("int")
    one = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end"), F.lit(0).alias("left_ramp"), F.lit(0).alias("right_ramp")))

    def tile(i: Column) -> Column:
        start = i * (size - overlap)
        return F.struct(
            start.cast("int").alias("start"),
            F.when(i == amount - 1, n).otherwise(start + size).cast("int").alias("end"),
            F.when(i == 0, 0).otherwise(overlap).alias("left_ramp"),
            F.when(i == amount - 1, 0).otherwise(overlap).alias("right_ramp"),
        )

    return F.when(n <= size, one).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(amount - 1, F.lit(0))), tile))


def tiles_by_count(n: Column, count: int, overlap: int) -> Column:
    """``count`` tiles; the first ones take the remainder, one each."""
    base = F.floor((n + overlap * (count - 1)) / count).cast("int")
    rest = (n + overlap * (count - 1) - base * count).cast("int")

    def tile(i: Column) -> Column:
        start = i * (base - overlap) + F.least(i, rest)
        return F.struct(
            start.cast("int").alias("start"),
            (start + base + F.when(i < rest, 1).otherwise(0)).cast("int").alias("end"),
            F.when(i == 0, 0).otherwise(overlap).alias("left_ramp"),
            F.when(i == count - 1, 0).otherwise(overlap).alias("right_ramp"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), tile)


def trapezoid(i: Column, length: Column, left: Column, right: Column) -> Column:
    """Weight of place i in a tile whose ends rise and fall over their ramps."""
    up = F.when(i < left, (i + 1) / (left + 1)).otherwise(F.lit(1.0))
    down = F.when(i >= length - right, (length - i) / (right + 1)).otherwise(F.lit(1.0))
    return F.least(up, down)


def patch_bounds(i: Column, scale: int, causal: bool = False) -> tuple[Column, Column]:
    """Pixel bounds of patch i; with ``causal`` the first patch covers one frame."""
    start, end = i * scale, (i + 1) * scale
    if not causal:
        return start, end
    return F.greatest(F.lit(0), start + 1 - scale), F.greatest(F.lit(0), end + 1 - scale)


def shifted_sigma(t: Column, mu: float, power: float = 1.0) -> Column:
    """Time shift e^mu / (e^mu + (1/t - 1)^power); 0 stays 0."""
    return F.when(t <= 0, F.lit(0.0)).otherwise(math.exp(mu) / (math.exp(mu) + F.pow(1 / t - 1, F.lit(power))))


def stretched(sigma: Column, last: Column, terminal: float) -> Column:
    """Sigmas rescaled so that the last positive one is ``terminal``."""
    return 1 - (1 - sigma) * (1 - terminal) / (1 - last)


def nearest_resample(a: Column, n: int) -> Column:
    """A list at n places by nearest earlier element."""
    return F.transform(indices(n), lambda i: F.get(a, F.floor(i * F.size(a) / n).cast("int")))


def to_latent_region(lo: Column, hi: Column, scale: int, size: Column) -> tuple[Column, Column]:
    """A pixel range as a clamped latent range of one cell at least."""
    start = F.greatest(F.lit(0), F.least(F.floor(lo / scale), size - 1))
    return start, F.greatest(start + 1, F.least(F.ceil(hi / scale), size))


def timecode_seconds(s: Column) -> Column:
    """123 (frames stay a number), 12.5s, HH:MM:SS.nnn -> seconds."""
    parts = F.split(s, ":")
    clock = F.aggregate(F.transform(parts, lambda p: p.cast("double")), F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(s.rlike("s$"), F.regexp_replace(s, "s$", "").try_cast("double")).when(s.contains(":"), clock).otherwise(s.try_cast("double"))
