"""Patches, tiles and timings of latent grids, and step recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def causal_tiles(tiles: Column) -> Column:
    """Tiles of a causal axis: all but the first start one earlier, with a ramp one longer."""
    moved = lambda x: F.struct((x.start - 1).alias("start"), x["end"].alias("end"), (x.left_ramp + 1).alias("left_ramp"), x.right_ramp.alias("right_ramp"))
    return F.transform(tiles, lambda x, i: F.when(i == 0, x).otherwise(moved(x)))


def frame_tiles(tiles: Column) -> Column:
    """Tiles in frames: all but the last end one later, and none falls off to the right."""
    last = F.size(tiles) - 1
    return F.transform(tiles, lambda x, i: F.struct(x.start.alias("start"), (x["end"] + F.when(i < last, 1).otherwise(0)).alias("end"), x.left_ramp.alias("left_ramp"), F.lit(0).alias("right_ramp")))


def patch_of(row: Column, col: Column, size: int, per_row: Column) -> tuple[Column, Column]:
    """(patch, place inside it) of a cell of a grid whose rows hold ``per_row`` patches of size x size."""
    return F.floor(row / size) * per_row + F.floor(col / size), (row % size) * size + col % size


def cell_of(patch: Column, place: Column, size: int, per_row: Column) -> tuple[Column, Column]:
    """The inverse of ``patch_of``: (row, col)."""
    return F.floor(patch / per_row) * size + F.floor(place / size), (patch % per_row) * size + place % size


def audio_bounds(i: Column, hop: int, rate: int, stride: int) -> tuple[Column, Column]:
    """Seconds at which latent i of an audio track starts and ends; the first one covers a single frame."""
    at = lambda k: F.greatest(F.lit(0), k * stride + 1 - stride) * (hop / rate)
    return at(i), at(i + 1)


def linear_quadratic(step: Column, steps: Column, threshold: float = 0.025) -> Column:
    """Noise level of a schedule that falls linearly to 1 - threshold in half its steps, then along the
    parabola that joins on with the same slope and reaches 0 at the end. One step goes from 1 to 0 at once."""
    line = F.floor(steps / 2)
    rest = steps - line
    slope = F.try_divide(F.lit(threshold), line)  # null for one step
    bend = (1 - threshold - slope * rest) / (rest * rest)
    past = step - line
    return F.when(step >= steps, 0.0).when(step <= 0, 1.0).when(step <= line, 1 - slope * step).otherwise(1 - threshold - slope * past - bend * past * past)


def euler(sample: Column, denoised: Column, sigma: Column, sigma_next: Column) -> Column:
    """One Euler step along the velocity."""
    return sample + (sample - denoised) / sigma * (sigma_next - sigma)


def trimmed(samples: Column, n: Column) -> Column:
    """A track cut to n samples, or filled up with zeros."""
    zero = F.lit(0).cast("double")
    return F.concat(F.slice(samples, 1, F.greatest(n, F.lit(0))), F.array_repeat(zero, F.greatest(n - F.size(samples), F.lit(0))))


def prefix_visibility(tokens: DataFrame, batch: str, pos: str, valid: str, image: str) -> DataFrame:
    """Pairs of one sequence's valid tokens that see each other: causal, or both of one run of image tokens."""
    on = F.col(valid) & F.col(image)
    island = F.col(pos) - F.row_number().over(Window.partitionBy(batch, on).orderBy(pos))
    rows = tokens.where(F.col(valid)).select(batch, F.col(pos).alias("p"), F.when(on, island).alias("run"))
    q = rows.select(batch, F.col("p").alias("q"), F.col("run").alias("q_run"))
    k = rows.select(batch, F.col("p").alias("k"), F.col("run").alias("k_run"))
    return q.join(k, batch).where((F.col("k") <= F.col("q")) | (F.col("q_run") == F.col("k_run"))).select(batch, "q", "k")


def local_links(side: int) -> Column:
    """Query (row, col) of a side x side grid with the four cells of a grid of twice the side that it sees, as an
    array of (query, evidence)."""
    every = F.sequence(F.lit(0), F.lit(side * side - 1))

    def four(i: Column) -> Column:
        top = F.floor(i / side) * 2 * (2 * side) + (i % side) * 2
        return F.transform(F.array(*map(F.lit, (0, 1, 2 * side, 2 * side + 1))), lambda d: F.struct(i.alias("query"), (top + d).cast("long").alias("evidence")))

    return F.flatten(F.transform(every, four))
