"""Scalar arithmetic with the guards that every score relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """``x`` held between 0 and 1; null, NaN and infinite values are 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b.isNull() | (b == 0) | F.isnan(b.cast("double")), default).otherwise(a / b)


def log_share(x: Column, reference: float) -> Column:
    """ln(1 + x) as a share of ln(1 + reference), at most 1."""
    return clamp01(F.log1p(x.cast("double")) / F.log1p(F.lit(float(reference))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def out(x: Column) -> Column:
    """Six decimals, as in every result."""
    return F.round(x, 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
