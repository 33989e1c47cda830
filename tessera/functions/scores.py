"""Numbers of ranking and lifecycle as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
STALE_FACTOR, MIN_SAMPLES = 0.85, 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for null, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def padded(vector: Column, size: int) -> Column:
    """Short vectors get zeros, long ones are refused (null)."""
    return F.when(F.size(vector) <= size, F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), size - F.size(vector))))


def idf(n: Column, df: Column) -> Column:
    """H31."""
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def bm25_term(tf: Column, length: Column, mean_length: Column, n: Column, df: Column) -> Column:
    return F.when(tf > 0, idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))).otherwise(0.0)


def quality_factor(adopted: Column, ignored: Column) -> Column:
    """1 for fewer than MIN_SAMPLES samples; null counts are 0."""
    a, t = F.coalesce(adopted, F.lit(0)), F.coalesce(adopted, F.lit(0)) + F.coalesce(ignored, F.lit(0))
    return F.when(t >= MIN_SAMPLES, 0.5 + 0.5 * a / (t + 1)).otherwise(1.0)


def stale_factor(status: Column) -> Column:
    """H33."""
    return F.when(status == "stale", STALE_FACTOR).otherwise(1.0)


def backoff_seconds(attempts: Column) -> Column:
    """H22."""
    return F.least(F.lit(300), attempts * 5)


def window_quality(coverage: Column, density: Column) -> Column:
    """H35."""
    return F.least(F.lit(1.2), F.greatest(F.lit(0.8), 0.8 + F.least(F.lit(0.3), 0.05 * coverage + 5 * density)))


def section_multiplier(overlap: Column, depth: Column, deepest: Column, tokens: Column, leaf_tokens: int = 2000) -> Column:
    """H36."""
    deep = F.when(deepest > 0, 0.1 * depth / deepest).otherwise(0.0)
    return F.greatest(F.lit(0.8), F.least(F.lit(1.2), 0.8 + F.least(F.lit(0.25), 0.2 * overlap) + deep + F.when(tokens <= leaf_tokens, 0.05).otherwise(0.0)))
