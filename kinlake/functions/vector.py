"""Vector arithmetic on array columns, in the JVM: no Python, but higher-order functions, which are evaluated row by row. Where all pairs of large groups are wanted, operators.evidence multiplies blocks instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """dot / (|a| |b| + 1e-9); norms may be given where a vector meets many others."""
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + F.lit(1e-9))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / norm(v))


def top_average(similarities: Column, k: int) -> Column:
    """The mean of the k largest of an array; null for an empty one."""
    best = F.slice(F.sort_array(similarities, False), 1, k)
    return F.when(F.size(best) > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best))
