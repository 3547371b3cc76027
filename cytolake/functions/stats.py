"""Aggregate helpers: sample-adjusted moments and sparse-safe moments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Sample-adjusted excess kurtosis."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def bimodality(skew: Column, kurt: Column, n: Column) -> Column:
    """Bimodality coefficient from sample-adjusted moments."""
    return F.try_divide(skew * skew + 1, kurt + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))


def sparse_mean(total: Column, n: Column) -> Column:
    """Mean over all ``n`` cells, the absent rows being zeros."""
    return F.try_divide(total, n)


def sparse_variance(total: Column, squares: Column, n: Column) -> Column:
    """Sample variance over all ``n`` cells, the absent rows being zeros; never below zero."""
    return F.when(n > 1, F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1)))
