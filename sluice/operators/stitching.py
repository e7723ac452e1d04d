"""Overlapping tiles back to one signal.

A tile's weight rises over what it shares with the tile before and falls over what it shares with the tile behind, so that ramps come
from the neighbours' ends and weights of neighbours sum to one everywhere. Cells are summed partially before their shuffle (w x and w), so tiles are
never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def tile_bounds(size: Column, tile: int, overlap: int) -> Column:
    """(start, end) of tiles of ``tile`` cells that share ``overlap`` with the next; the last one may be shorter. One tile if all fits."""
    if not 0 <= overlap < tile:
        raise ValueError("a tile must be longer than its overlap")
    step = tile - overlap
    amount = F.when(size <= tile, 1).otherwise(F.floor((size + tile - 2 * overlap - 1) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), amount - 1), lambda i: F.struct((i * step).alias("start"), F.least(size, i * step + tile).cast("int").alias("end")))


def with_ramps(tiles: DataFrame, on: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``tiles`` with left_ramp and right_ramp: cells shared with the neighbours in order of start. A tile may share
    cells with its two neighbours only."""
    along = Window.partitionBy(*on).orderBy(start)
    left = F.lag(end).over(along) - F.col(start)
    right = F.col(end) - F.lead(start).over(along)
    return tiles.withColumn("left_ramp", F.greatest(F.lit(0), F.coalesce(left, F.lit(0)))).withColumn("right_ramp", F.greatest(F.lit(0), F.coalesce(right, F.lit(0))))


def weight(i: Column, length: Column, left: Column, right: Column) -> Column:
    """The weight of cell i of a tile: (i + 1) / (ramp + 1) in the left ramp, its mirror in the right one, else 1."""
    rising = F.when(i < left, (i + 1) / (left + 1)).otherwise(1.0)
    falling = F.when(i >= length - right, (length - i) / (right + 1)).otherwise(1.0)
    return F.least(rising, falling)


def stitched(tiles: DataFrame, on: list[str], values: str, start: str = "start", end: str = "end") -> DataFrame:
    """(on, cell, value, total) of tiles whose ``values`` are lists over [start, end): the weighted mean of each cell, and its total weight."""
    cells = with_ramps(tiles, on, start, end).select(*on, start, end, "left_ramp", "right_ramp", F.posexplode(values).alias("_i", "_x"))
    w = weight(F.col("_i"), F.col(end) - F.col(start), F.col("left_ramp"), F.col("right_ramp"))
    summed = cells.groupBy(*on, (F.col(start) + F.col("_i")).alias("cell")).agg(F.sum(w * F.col("_x")).alias("_wx"), F.sum(w).alias("total"))
    return summed.select(*on, "cell", (F.col("_wx") / (F.col("total") + EPS)).alias("value"), "total")
