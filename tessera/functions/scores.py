"""Scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(x: Column) -> Column:
    """Clamp to [0, 1]; not a number counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    norm = k1 * (1 - b + b * F.when(average > 0, length / average).otherwise(0.0))
    return tf * (k1 + 1) / (tf + norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def overlap_score(query: Column, doc: Column) -> Column:
    """0.8 coverage + 0.2 Jaccard of two distinct token arrays."""
    both = F.size(F.array_intersect(query, doc))
    return F.when(F.size(query) > 0, 0.8 * both / F.size(query) + 0.2 * both / F.size(F.array_union(query, doc))).otherwise(0.0)


def back_off(attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Seconds to wait before the next attempt."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
