"""Routing of rows: the first failing check names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that holds, in order; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for reason, bad in checks])


def with_reason(df: DataFrame, checks: list[tuple[str, Column]], column: str = "reason") -> DataFrame:
    return df.withColumn(column, first_reason(checks))


def split_rows(df: DataFrame, column: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(accepted without the reason, rejected)."""
    return df.where(F.col(column).isNull()).drop(column), df.where(F.col(column).isNotNull())


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def crop_problem(crop: Column, width: Column, height: Column) -> Column:
    """Whether (x0, y0, x1, y1) is malformed or not inside the media."""
    x0, y0, x1, y1 = (F.get(crop, i) for i in range(4))
    inside = (x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height)
    return crop.isNotNull() & ((F.size(crop) != 4) | ~F.coalesce(inside, F.lit(False)))


def clip_problem(start: Column, end: Column, frames: Column | None = None) -> Column:
    bad = (start < 0) | (end <= start)
    return bad if frames is None else bad | (end > frames)


def strictly_increasing(a: Column) -> Column:
    """A non-empty list in strictly ascending order."""
    pairs = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x < y)
    return (F.size(a) > 0) & F.forall(pairs, lambda ok: ok)


def preflight(df: DataFrame, required: list[str]) -> list[str]:
    """Required fields that the first row lacks; dotted names reach into structs. Only
    the first row is looked at, as a dataset-level gate before any row is judged."""
    row = df.limit(1).collect()
    if not row:
        return []
    missing = []
    for name in required:
        value = row[0].asDict(recursive=True)
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            missing.append(name)
    return missing
