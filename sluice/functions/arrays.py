"""Vector and list functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def rms(a: Column, eps: float = 1e-6) -> Column:
    return F.sqrt(squared_norm(a) / F.size(a) + eps)


def projection(a: Column, b: Column) -> Column:
    """Coefficient of a along b."""
    return dot(a, b) / (squared_norm(b) + 1e-8)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b)))


def pad_to(a: Column, n: Column, filler: Column) -> Column:
    return F.concat(a, F.array_repeat(filler, F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def forward_pad(a: Column, n: Column) -> Column:
    """Longer by repeats of the last element."""
    return pad_to(a, n, F.element_at(a, -1))


def gather(a: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.get(a, i))


def split_sizes(n: Column, size: int) -> Column:
    """Sizes of chunks of at most ``size``."""
    full, rest = F.floor(n / size).cast("int"), (n % size).cast("int")
    return F.concat(F.array_repeat(F.lit(size), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))


def in_list(x: Column, allowed: Column) -> Column:
    """Membership where a null list allows all."""
    return allowed.isNull() | F.array_contains(allowed, x)
