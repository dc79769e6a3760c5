"""Expressions over short arrays (a few rows of history): no UDF, no extra shuffle."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column, default: float | None = None) -> Column:
    m = total(a) / F.nullif(F.size(a).cast("double"), F.lit(0.0))
    return m if default is None else F.coalesce(m, F.lit(default))


def sample_std(a: Column) -> Column:
    """Sample standard deviation, 0 below two values."""
    m = mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(F.sqrt(ss / (F.size(a) - 1)))


def slope(a: Column) -> Column:
    """Least-squares slope against 0..n-1, 0 below two values."""
    n = F.size(a).cast("double")
    pos = F.transform(a, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("v")))
    num = F.aggregate(pos, F.lit(0.0), lambda s, p: s + (p["i"] - (n - 1) / 2) * p["v"])
    return F.when(n < 2, F.lit(0.0)).otherwise(num / (n * (n * n - 1) / 12))
