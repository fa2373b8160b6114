"""Math scalars. The three kinds of deciles stay apart: each has its own edges and closure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log10_hits(hits: Column) -> Column:
    """M1: log10 of positive counts, null otherwise."""
    return F.when(hits > 0, F.log10(hits.cast("double")))


def log10p1(x: Column) -> Column:
    """M2"""
    return F.log10(x.cast("double") + 1)


def quote_bin(count: Column) -> Column:
    """M3: whole octaves of a count: one less than its binary digits, which no rounding can change."""
    return F.when(count > 0, F.length(F.bin(count.cast("long"))) - 1)


def decile_right_closed(x: Column, edges: Column) -> Column:
    """M4: 0 to 9 from eleven edges; bins closed on the right, the last takes the rest."""
    return F.when(x.isNotNull(), F.size(F.filter(F.slice(edges, 2, 9), lambda e: e < x)))


def decile_left_closed(x: Column, edges: Column) -> Column:
    """M5: 0 to 9 from eleven edges with open ends; bins closed on the left."""
    return F.when(x.isNotNull(), F.size(F.filter(F.slice(edges, 2, 9), lambda e: e <= x)))


def quantile_bin(x: Column, edges: Column) -> Column:
    """From 1, closed on the right, repeated edges dropped."""
    below = F.size(F.filter(F.array_distinct(edges), lambda e: e < x))
    return F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)) + 1)


def unit(v: Column) -> Column:
    """M6: vector over its length, at least 1e-12."""
    d = F.transform(v, lambda x: x.cast("double"))
    length = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(d, lambda x: x / length)


def dot(a: Column, b: Column) -> Column:
    """M7: cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def z_score(difference: Column, se_a: Column, se_b: Column) -> Column:
    """M8: null if either error is missing or both are zero."""
    return F.try_divide(F.abs(difference), F.sqrt(se_a * se_a + se_b * se_b))


def interval(mean: Column, se: Column, z: float = 1.96) -> tuple[Column, Column]:
    """M9"""
    return mean - z * se, mean + z * se


def filled_errors(std: Column, variance: Column, se: Column, n: Column) -> tuple[Column, Column]:
    """M9: std from the variance and se from std where missing."""
    full = F.coalesce(std, F.sqrt(variance))
    return full, F.coalesce(se, F.try_divide(full, F.sqrt(n.cast("double"))))


def rms(total_squared_error: Column, groups: Column, n: Column) -> Column:
    """M11"""
    return F.sqrt(F.try_divide(total_squared_error, groups * n))
