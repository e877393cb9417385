import itertools
import math
import time
from fractions import Fraction

import pytest

from lethe.functions.ks import _asymptotic, _exact_equal, _exact_walk, pvalue

PUBLISHED = [
    (40, 17, 1.27e-03), (40, 16, 3.02e-03), (40, 19, 1.88e-04), (200, 51, 4.02e-06), (200, 78, 5.87e-14),
    (200, 200, 1.94e-119), (400, 149, 4.35e-25), (400, 379, 1.47e-198), (400, 400, 1.06e-239),
]


@pytest.mark.parametrize("n,h,p", PUBLISHED)
def test_published_values(n, h, p):
    assert f"{pvalue(h * n, n, n):.2e}" == f"{p:.2e}"


def brute(n1, n2, gap):
    """Share of all orderings of the pooled sample that reach the gap."""
    hits = total = 0
    for firsts in itertools.combinations(range(n1 + n2), n1):
        i = j = 0
        reached = False
        for k in range(n1 + n2):
            i, j = (i + 1, j) if k in firsts else (i, j + 1)
            reached |= abs(i * n2 - j * n1) >= gap
        hits += reached
        total += 1
    return hits / total


@pytest.mark.parametrize("n1,n2", [(3, 5), (5, 3), (4, 6), (5, 5), (1, 4), (6, 7)])
def test_exact_against_all_orderings(n1, n2):
    for gap in range(1, n1 * n2 + 1):
        assert math.isclose(_exact_walk(n1, n2, gap), brute(n1, n2, gap), rel_tol=1e-12, abs_tol=1e-15)


def full_walk(n1, n2, gap):
    """The same walk over all points of the lattice, in whole numbers."""
    ways = {(0, 0): 1}
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if i or j:
                inside = abs(i * n2 - j * n1) < gap
                ways[i, j] = (ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)) if inside else 0
    return 1 - Fraction(ways[n1, n2], math.comb(n1 + n2, n1))


@pytest.mark.parametrize("n1,n2", [(1, 1), (1, 9), (20, 21), (13, 40), (60, 7), (30, 30)])
def test_band_against_the_full_walk(n1, n2):
    for gap in {1, 2, n1 + n2 - 1, n1 + n2, n1 + n2 + 1, n1 * n2 // 3 + 1, n1 * n2 // 2 + 1, n1 * n2}:
        assert math.isclose(_exact_walk(n1, n2, gap), float(full_walk(n1, n2, gap)), rel_tol=1e-12, abs_tol=1e-15)


def test_unequal_large_samples_are_quick():
    n1, n2 = 100_000, 100_001
    gap = n1 * n2 // 100
    start = time.perf_counter()
    exact = pvalue(gap, n1, n2)
    assert time.perf_counter() - start < 20
    assert exact == pytest.approx(pvalue(n1 * 1000, n1, n1), rel=1e-2)


def test_equal_sizes_agree_in_both_ways():
    for n, h in ((7, 3), (50, 11), (300, 40)):
        assert math.isclose(_exact_equal(n, h), _exact_walk(n, n, n * h), rel_tol=1e-9)


def test_limits():
    assert pvalue(0, 10, 10) == 1.0
    assert 0.0 <= _asymptotic(20_000, 30_000, 20_000 * 30_000 // 50) < 1e-3
    exact = pvalue(int(0.03 * 9000 * 9000), 9000, 9000)
    assert math.isclose(exact, _asymptotic(9000, 9000, int(0.03 * 9000 * 9000)), rel_tol=0.05)


def binomials(n, h):
    """The same series in whole numbers."""
    total = sum((1 if k % 2 else -1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1))
    return 2 * total / math.comb(2 * n, n)


@pytest.mark.parametrize("n,h", [(1, 1), (2, 1), (5, 5), (19, 4), (21, 20), (100, 3), (999, 40), (1000, 1000), (1000, 1)])
def test_series_against_whole_numbers(n, h):
    assert math.isclose(_exact_equal(n, h), binomials(n, h), rel_tol=1e-9)


def test_no_step_between_sizes():
    values = [pvalue(120 * n, n, n) for n in range(9_996, 10_004)]
    steps = [abs(a - b) / a for a, b in zip(values, values[1:])]
    assert max(steps) < 1e-3
    values = [pvalue(12 * n, n, 100, "exact") for n in (9_999, 10_000, 10_001)]
    assert max(values) / min(values) < 1.02


def test_small_gaps_of_large_samples_are_quick():
    start = time.perf_counter()
    assert pvalue(10_000, 10_000, 10_000) == pytest.approx(1.0)
    assert pvalue(10**9 * 40_000, 10**9, 10**9) == pytest.approx(_asymptotic(10**9, 10**9, 10**9 * 40_000), rel=1e-3)
    assert time.perf_counter() - start < 5


def test_method_is_the_callers():
    assert pvalue(30 * 50, 50, 50, "limit") == _asymptotic(50, 50, 1500) != pvalue(1500, 50, 50)
    with pytest.raises(ValueError, match="method"):
        pvalue(5, 5, 5, "auto")
