"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = -1e9  # stands for the logarithm of nothing


def dirichlet(tf: Column, p_wc: Column, dl: Column, mu: float) -> Column:
    """Smoothed probability of a term in a document; 0 for a document without length."""
    p = (F.coalesce(tf, F.lit(0)) + F.lit(mu) * F.coalesce(p_wc, F.lit(0.0))) / (dl + F.lit(mu))
    return F.when(F.coalesce(dl, F.lit(0)) == 0, F.lit(0.0)).otherwise(p)


def log_likelihood(p: Column, times: Column) -> Column:
    """Aggregate: the sum of ``times`` ln ``p``, or FLOOR if any ``p`` is not over 0."""
    return F.when(F.min(p) <= 0, F.lit(FLOOR)).otherwise(F.sum(times * F.log(F.when(p > 0, p))))


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avg_dl: Column, k1: float, b: float) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + k1 * (1 - b + b * dl / avg_dl))


def min_max_100(score: Column, low: Column, high: Column) -> Column:
    """0 to 100 between ``low`` and ``high``; 0 where they are equal."""
    return 100 * (score - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def rrf(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def dense_score(distance: Column) -> Column:
    """1 - d/2, which for unit vectors and squared distance is the cosine; 0 without a distance."""
    return F.when(distance.isNull(), F.lit(0.0)).otherwise(1 - distance / 2)


def insufficiency(n: Column, average: Column, min_results: int = 3, min_score: float = -50.0, empty_is_insufficient: bool = True) -> Column:
    """0 (enough) to 1: six tenths for too few results, four for a low average score."""
    few = F.when(n < min_results, (F.lit(min_results) - n) / F.lit(float(min_results))).otherwise(0.0)
    low = F.when(average < min_score, F.least(F.lit(1.0), (F.lit(min_score) - average) / 100)).otherwise(0.0)
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * few + 0.4 * low))
    return F.when(n == 0, F.lit(1.0 if empty_is_insufficient else 0.0)).otherwise(mixed)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
