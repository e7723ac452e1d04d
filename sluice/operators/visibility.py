"""Which tokens see which, as short lists of ranges instead of pairs.

Valid tokens of a sequence are numbered in order, and a query's visible keys are a list of [start, end) over these numbers, in order
and without overlaps. So invalid tokens need no test, causal visibility is one range, and output grows with tokens, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import dealt

#: A frame has a grid of evidence cells and one of half its side of queries.
EVIDENCE_SIDE, QUERY_SIDE = 16, 8


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def merged(ranges: Column) -> Column:
    """Ranges in order, those that touch or overlap put together, empty ones left out."""
    ordered = F.array_sort(F.filter(ranges, lambda r: r.end > r.start))

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        meets = (F.size(acc) > 0) & (r.start <= last.end)
        longer = span(last.start, F.greatest(last.end, r.end))
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def union(a: Column, b: Column) -> Column:
    return merged(F.concat(a, b))


def intersection(a: Column, b: Column) -> Column:
    """What two lists have in common: all pairs of ranges, as both lists are short."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: span(F.greatest(x.start, y.start), F.least(x.end, y.end)))))
    return merged(pairs)


def behind_prefix(m: Column, start: Column, end: Column, *rest: Column) -> Column:
    """The merged list of [0, m), [start, end) and ``rest``, where start >= m and ``rest`` is in order, not empty and touches nothing."""
    touching = F.array(span(F.lit(0), end), *rest)
    return F.when(start <= m, touching).when(m > 0, F.array(span(F.lit(0), m), span(start, end), *rest)).otherwise(F.array(span(start, end), *rest))


def visible(ranges: Column) -> Column:
    """How many keys a list holds."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r.end - r.start)


def _numbered(tokens: DataFrame, batch: str, pos: str, valid: str, image: str) -> DataFrame:
    """Valid tokens with their number n and, for image tokens, the number behind the last of their run as ``run_end``. Runs are of neighbouring positions."""
    along = Window.partitionBy(batch).orderBy(pos)
    rows = tokens.where(F.col(valid)).withColumn("n", F.row_number().over(along) - 1)
    island = F.col(pos) - F.row_number().over(Window.partitionBy(batch, image).orderBy(pos))
    rows = rows.withColumn("_island", F.when(F.col(image), island))
    end = F.max(F.col("n") + 1).over(Window.partitionBy(batch, "_island"))
    return rows.withColumn("run_end", F.when(F.col(image), end)).drop("_island")


def prefix_ranges(tokens: DataFrame, batch: str, pos: str, valid: str, image: str) -> DataFrame:
    """(batch, pos, n, ranges) of each valid token: what stands before it, itself, and all of its run of image tokens."""
    rows = _numbered(tokens, batch, pos, valid, image)
    return rows.select(batch, pos, "n", F.array(span(F.lit(0), F.greatest(F.col("n") + 1, F.coalesce("run_end", F.lit(0))))).alias("ranges"))


def sliding_ranges(tokens: DataFrame, batch: str, pos: str, valid: str, image: str, width: int) -> DataFrame:
    """The same within less than ``width`` positions, on both sides."""
    rows = _numbered(tokens, batch, pos, valid, image)
    near = Window.partitionBy(batch).orderBy(F.col(pos).cast("long"))
    before = F.count(F.lit(1)).over(near.rangeBetween(-(width - 1), -1))
    after = F.count(F.lit(1)).over(near.rangeBetween(1, width - 1)) if width > 1 else F.lit(0)
    before = before if width > 1 else F.lit(0)
    ahead = F.least(F.col("n") + 1 + after, F.coalesce("run_end", F.col("n") + 1))
    return rows.select(batch, pos, "n", F.array(span(F.col("n") - before, ahead)).alias("ranges"))


def teacher_ranges(tokens: DataFrame, frames: DataFrame, batch: str, pos: str, valid: str, image: str) -> DataFrame:
    """(batch, part, n, ranges) of a prefix and the frames behind it. frames: batch, frames.

    Prefix tokens see as in ``prefix_ranges``. Frame f has evidence cells, then queries. Evidence sees the prefix and its frame's
    evidence; a query sees the prefix, the 2 x 2 evidence cells under it, and itself. Batches are dealt over tasks by their number, as each
makes hundreds of rows a frame."""
    prefix = prefix_ranges(tokens, batch, pos, valid, image)
    length = tokens.where(F.col(valid)).groupBy(batch).agg(F.count(F.lit(1)).alias("m"))
    cells, queries = EVIDENCE_SIDE**2, QUERY_SIDE**2
    sized = frames.join(length, batch, "left").withColumn("m", F.coalesce("m", F.lit(0)))
    every = dealt(sized, frames, 256).withColumn("f", F.explode(F.sequence(F.lit(0), F.col("frames") - 1))).where("frames > 0")
    every = every.withColumn("base", F.col("m") + F.col("f") * (cells + queries)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cells + queries - 1))))
    q = F.col("i") - cells
    top = F.col("base") + F.floor(q / QUERY_SIDE) * 2 * EVIDENCE_SIDE + (q % QUERY_SIDE) * 2
    own = F.col("base") + F.col("i")
    m = F.col("m")
    seen = F.when(F.col("i") < cells, behind_prefix(m, F.col("base"), F.col("base") + cells)).otherwise(
        behind_prefix(m, top, top + 2, span(top + EVIDENCE_SIDE, top + EVIDENCE_SIDE + 2), span(own, own + 1))
    )
    behind = every.select(batch, F.when(F.col("i") < cells, "evidence").otherwise("query").alias("part"), own.cast("long").alias("n"), seen.alias("ranges"))
    return prefix.select(batch, F.lit("prefix").alias("part"), F.col("n").cast("long").alias("n"), "ranges").unionByName(behind)


def pairs(ranges: DataFrame, *columns: str) -> DataFrame:
    """A row per visible key, for masks of bounded size."""
    keys = F.flatten(F.transform("ranges", lambda r: F.sequence(r.start, r.end - 1)))
    return ranges.select(*columns, F.explode(keys).alias("k"))
