"""P-value of the two-sample Kolmogorov-Smirnov test, one scalar per row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)
METHODS = ("exact", "limit")
SMALLEST = 1e-22  # terms below this do not change a double


def _stirling_rest(x: np.ndarray) -> np.ndarray:
    """ln x! less Stirling's main part, for x >= 1."""
    main = np.maximum(x, 20.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * main**2)) / main**2) / main**2) / main
    small = np.array([math.lgamma(v + 1) - ((v + 0.5) * math.log(v) - v + HALF_LOG_TAU) for v in range(1, 21)])
    return np.where(x < 20, small[np.minimum(x, 20).astype(int) - 1], series)


def _log_ratio(n: int, m: np.ndarray) -> np.ndarray:
    """ln of C(2n, n - m) / C(2n, n), without the large logarithms that cancel in it."""
    up = np.log1p(m / n)
    rest = _stirling_rest(n + m) - 2 * _stirling_rest(np.array([float(n)]))
    inner = m < n
    low = np.where(inner, n - m, 1.0)
    down = np.log1p(-np.where(inner, m, 0.0) / n)
    whole = (n + m + 0.5) * up + np.where(
        inner, (low + 0.5) * down + _stirling_rest(low), -n - 0.5 * math.log(n) + n - HALF_LOG_TAU
    )
    return -(whole + rest)


def _exact_equal(n: int, h: int) -> float:
    """P(max gap >= h/n) for two samples of size n: a reflection series of binomials,
    for any n.  Terms fall like a normal density, so few hundred times sqrt(n) / h count."""
    total, first, step = 0.0, 1, 1 << 16
    while first <= n // h:
        k = np.arange(first, min(n // h, first + step - 1) + 1, dtype=np.float64)
        terms = np.exp(_log_ratio(n, k * h))
        total += float(np.where(k % 2 == 1, terms, -terms).sum())
        if terms[-1] < SMALLEST * max(abs(total), 1e-300):
            break
        first += step
    return 2 * total


def _band(n1: int, n2: int, gap: int, step: int) -> tuple[int, int]:
    """First and last i with |i*n2 - (step - i)*n1| < gap, 0 <= i <= n1 and 0 <= step - i <= n2."""
    both = n1 + n2
    first = (step * n1 - gap) // both + 1
    last = -((-(step * n1 + gap)) // both) - 1
    return max(first, 0, step - n2), min(last, n1, step)


def _exact_walk(n1: int, n2: int, gap: int) -> float:
    """P(some lattice point has |i*n2 - j*n1| >= gap) by following the walk that
    draws from the pooled sample; leaving mass is only ever added up.

    Only points inside the band are held: at each step those i whose point is
    nearer than `gap`, about 2 * gap / (n1 + n2) of them.  A step leaves the band
    at its ends alone, for neighbouring points differ by n1 + n2.
    """
    first, last = _band(n1, n2, gap, 0)
    if first > last:
        return 1.0
    inside, left = np.ones(1), 0.0
    for step in range(1, n1 + n2 + 1):
        remaining = n1 + n2 - step + 1
        i = np.arange(first, first + len(inside))
        up, stay = inside * ((n1 - i) / remaining), inside * ((n2 - (step - 1 - i)) / remaining)
        # places first .. last + 1: stay keeps i, up raises it by one
        moved = np.zeros(len(inside) + 1)
        moved[:-1] += stay
        moved[1:] += up
        low, high = _band(n1, n2, gap, step)
        if low > high:
            return left + float(moved.sum())
        cut, end = max(low - first, 0), high - first + 1
        left += float(moved[:cut].sum()) + float(moved[end:].sum())
        inside, first = moved[cut:end], max(low, first)
        if not len(inside):
            return left
    return left


def _asymptotic(n1: int, n2: int, gap: int) -> float:
    d = gap / (n1 * n2)
    x = math.sqrt(n1 * n2 / (n1 + n2)) * d
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def pvalue(gap: int, n1: int, n2: int, method: str = "exact") -> float:
    """Two-sided p-value by one law for all sizes.

    "exact" is the finite-sample law: a series for equal sizes, a walk for unequal
    ones, of n1 + n2 steps over a band of 2 * gap / (n1 + n2) points.  "limit" is
    the Kolmogorov distribution.  `gap` is
    max |c1*n2 - c2*n1| over the pooled scores, an exact integer.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    if gap <= 0:
        return 1.0
    if method == "limit":
        return _asymptotic(n1, n2, gap)
    value = _exact_equal(n1, gap // n1) if n1 == n2 else _exact_walk(n1, n2, gap)
    return min(1.0, max(0.0, value))


def ks_pvalue(gap: Column, n1: Column, n2: Column, method: str = "exact") -> Column:
    @F.pandas_udf(T.DoubleType())
    def value(gap: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([pvalue(int(g), int(a), int(b), method) for g, a, b in zip(gap, n1, n2)], dtype="float64")

    return value(gap, n1, n2)
