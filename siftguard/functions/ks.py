"""Two-sample Kolmogorov-Smirnov test: critical values, p-values and a window kernel.

The p-value falls with the distance, so "p < alpha" is "gap >= critical gap". Gaps
are whole numbers: the largest ``|c1 * n2 - c2 * n1|`` over the cumulative counts.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, exp, gcd, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# With method "auto" samples up to this size are tested exactly, larger ones asymptotically.
EXACT_LIMIT = 10_000
METHODS = ("exact", "asymptotic", "auto")


def tail_probability(x: float) -> float:
    """Limit distribution of the scaled distance."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (j - 1) * exp(-2.0 * j * j * x * x) for j in range(1, 101))))


def _exact_equal(n: int, k: int) -> float:
    """P(distance >= k/n) for two samples of n, by the closed sum."""
    if k <= 0:
        return 1.0
    tail = sum((-1) ** (i - 1) * comb(2 * n, n + i * k) for i in range(1, n // k + 1))
    return 2 * tail / comb(2 * n, n)


def _exact_unequal(n1: int, n2: int, gap: int) -> float:
    """Share of lattice paths that touch the band ``|i*n2 - j*n1| >= gap``."""
    if gap <= 0:
        return 1.0
    inside = np.zeros(n1 + 1)
    inside[0] = 1.0
    i = np.arange(n1 + 1)
    for s in range(1, n1 + n2 + 1):
        j = s - i
        moved = np.zeros(n1 + 1)
        moved[1:] = inside[:-1] * i[1:] / s
        moved += inside * np.clip(j, 0, None) / s
        moved[(j < 0) | (j > n2) | (np.abs(i * n2 - j * n1) >= gap)] = 0.0
        inside = moved
    return float(1.0 - inside[n1])


def is_exact(n1: int, n2: int, method: str) -> bool:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return method == "exact" or (method == "auto" and max(n1, n2) <= EXACT_LIMIT)


@lru_cache(maxsize=4096)
def pvalue(n1: int, n2: int, gap: int, method: str = "auto") -> float:
    """Two-sided p-value of a gap (distance times n1 times n2)."""
    if not is_exact(n1, n2, method):
        return tail_probability(gap / (n1 * n2) * sqrt(n1 * n2 / (n1 + n2)))
    return _exact_equal(n1, -(-gap // n1)) if n1 == n2 else _exact_unequal(n1, n2, gap)


@lru_cache(maxsize=256)
def critical_gap(n1: int, n2: int, alpha: float, method: str = "auto") -> int:
    """Smallest gap that rejects at level ``alpha``; larger than any gap if none does.

    ``method`` is "exact", "asymptotic" or "auto" (exact up to ``EXACT_LIMIT`` rows a sample).
    """
    largest = n1 * n2
    unit = n1 if n1 == n2 else gcd(n1, n2)

    def rejects(step: int) -> bool:
        return pvalue(n1, n2, step * unit, method) < alpha

    low, high = 1, largest // unit
    if not rejects(high):
        return largest + 1
    while low < high:
        middle = (low + high) // 2
        if rejects(middle):
            high = middle
        else:
            low = middle + 1
    return low * unit


def exact_pvalue_column(distance: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided p-value; for tables with one row per test."""

    @F.pandas_udf("double")
    def exact(gap: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pvalue(int(x), int(y), int(g), "exact") for g, x, y in zip(gap, a, b)], dtype=float)

    return exact(F.round(distance * n1 * n2).cast("long"), n1.cast("long"), n2.cast("long"))


def pvalue_column(distance: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value."""
    x = distance * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda a, j: a + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def window_gaps(reference: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Gap of each window to one reference sample.

    ``reference`` is sorted with shape (n1,); ``windows`` has shape (w, n2). Only the
    window points need looking at: there the distance is reached from either side.
    """
    n1, n2 = len(reference), windows.shape[1]
    points = np.sort(windows, axis=1)
    upto = np.searchsorted(reference, points, side="right")
    below = np.searchsorted(reference, points, side="left")
    rank = np.arange(n2)
    above_ref = (rank + 1) * n1 - upto * n2
    under_ref = below * n2 - rank * n1
    return np.maximum(above_ref, under_ref).max(axis=1)
