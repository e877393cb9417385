"""Whitening and hard negatives against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import hard_negatives, whitening

ODD = [
    (None, [1.0] * 6, 1),
    (900, None, 1),
    (901, [1.0, None] + [0.0] * 4, 1),
    (902, [float("nan")] * 6, 2),
    (903, [float("inf")] * 6, 2),
    (904, [], 0),
    (905, [0.5, -0.25], 1),
    (906, [0.1] * 6, None),
]
SCHEMA = "vec_id bigint, embedding array<double>, label int, id int, v string, anchor int, n string, at int, w double"
CLASH = (1, "x", 2, "y", 3, 0.5)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def fits(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


# ---------------------------------------------------------------- whitening


def covariance_by_force(rows, dims):
    """Exact covariance of floor(64 c) + 1000000, as fractions."""
    xs = [[math.floor(64 * c) + 10**6 for c in v] + [10**6] * (dims - len(v)) for v in rows]
    n = len(xs)
    sums = [sum(x[i] for x in xs) for i in range(dims)]
    cov = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs) / Fraction(n**3) for j in range(dims)] for i in range(dims)]
    return xs, n, sums, cov


def test_whitened_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(3 * k, 1 + k) for k in range(6)], 0) for i in range(200)] + ODD
    rows += [rows[3], rows[3]] + [(500 + i, [2.0, 1.0, 0.0, 0.0, 0.0, -1.0], 0) for i in range(40)]
    found = whitening.whiten(table(spark, rows), components=4).collect()
    usable = [(i, v) for i, v, _ in rows if fits(v)]
    xs, n, sums, cov = covariance_by_force([v for _, v in usable], 6)
    values, vectors = np.linalg.eigh(np.array(cov, dtype=np.float64))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == 4 * n and {r.n for r in found} == {n}
    deviations = sorted((str(i), sum((n * x - s) ** 2 for x, s in zip(row, sums))) for (i, _), row in zip(usable, xs))
    assert sorted((str(r.vec_id), int(r.deviation)) for r in found if r.component == 2) == deviations
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums)] for row in xs])
    for c in range(4):
        got = [(r.vec_id, r.whitened) for r in found if r.component == c + 1]
        want = centred @ vectors[:, c] / math.sqrt(values[c])
        one = next(w for i, w in got if i == 7)
        sign = math.copysign(1, one * want[7])
        assert np.allclose(sorted(w for _, w in got), sorted(sign * want), atol=1e-9)
        assert {r.explained for r in found if r.component == c + 1}.pop() == pytest.approx(values[c] / values.sum(), rel=1e-12)
    assert {r.identity_error for r in found}.pop() < 1e-10
    assert whitening.whiten(table(spark, ODD[1:2])).count() == 0
    assert whitening.whiten(table(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0


def test_directions_without_spread_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(30)]
    assert {r.component for r in whitening.whiten(table(spark, rows)).select("component").distinct().collect()} == {1}


@pytest.mark.parametrize("gaps", [[1, 2, 3, 4, 5, 6], [1, 1 + 1e-9, 1 + 2e-9, 1 + 1e-12, 5, 5 + 1e-10], [2, 2, 2, 7, 7, 1e-6]])
def test_clustered_eigenvalues(gaps):
    rng = np.random.default_rng(3)
    wide = np.longdouble
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(wide)
    q = q @ (1.5 * np.eye(6, dtype=wide) - 0.5 * q.T @ q)  # orthogonal beyond double precision
    q = q @ (1.5 * np.eye(6, dtype=wide) - 0.5 * q.T @ q)
    a = q @ np.diag(np.array(gaps, dtype=wide)) @ q.T
    values, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(values - np.sort(np.array(gaps, dtype=wide))[::-1]).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-17
    assert np.abs(a @ x - x * values).max() < 1e-16
    # vectors of eigenvalues that differ by more than 1e-11 are right to double precision
    order = np.argsort(-np.array(gaps, dtype=np.float64), kind="stable")
    for k, column in enumerate(order):
        apart = np.abs(np.delete(np.array(gaps, dtype=wide), column) - gaps[column]).min()
        if apart > 1e-11:
            assert abs(abs(float(x[:, k] @ q[:, column])) - 1) < 1e-15


def test_single_precision_alone_would_not_do():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 40))
    a = (a + a.T).astype(np.longdouble)
    values, x = whitening.eigen(a)
    raw = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    off = raw.T @ a @ raw
    assert np.abs(off - np.diag(np.diag(off))).max() > 1e-8
    assert np.abs(a @ x - x * values).max() < 1e-15


def test_large_sums_are_exact():
    y = np.array([[2.0**39, 3.0], [2.0**38 + 1, -5.0]])
    assert whitening.gram(y).tolist() == [[2**78 + (2**38 + 1) ** 2, 3 * 2**39 - 5 * (2**38 + 1)], [3 * 2**39 - 5 * (2**38 + 1), 34]]


# ---------------------------------------------------------------- hard negatives


def negatives_by_force(rows, asked, positives, negatives, low, high):
    usable = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and fits(v)]
    out = []
    for a, v, label in [r for n, r in enumerate(usable) if r[0] in asked and r not in usable[:n]]:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, w, other in usable if i != a or other != label)
        for top, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * -top <= -100 * x[0] <= high * -top][:negatives]
            out += [(a, p, n + 1, i, -top, -s) for n, (s, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2048, 16384), (3, 11)])
def test_hard_negatives(spark, sizes):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 2) for _ in range(6)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 1) for c in centres[i % 3]], i % 4) for i in range(150)] + ODD
    rows += [(300 + i, [1.0] * 6, i % 2) for i in range(30)]  # ties
    rows += [rows[8], rows[8], rows[20]]  # repeated rows
    rows += [(400 + i, [0.0] * 6, i % 2) for i in range(12)]  # scores of zero
    asked = {i for i, _, _ in rows if i is not None and i % 10 == 0}
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, group_anchors=sizes[0], block_rows=sizes[1])
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_force(rows, asked, 5, 3, 50, 95)
    assert hard_negatives.mine(table(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(table(spark, rows), F.col("vec_id") < 0).count() == 0


def test_the_walk_needs_no_whole_anchor():
    import pandas as pd

    def pairs():
        yield pd.DataFrame({"anchor": [1], "anchor_id": [50], "falling": [-100], "kind": [0], "id": [7]})
        for i in range(1000):
            yield pd.DataFrame({"anchor": [1], "anchor_id": [50], "falling": [-90], "kind": [1], "id": [i]})

    steps = hard_negatives.walk(pairs(), 3, 50, 95)
    assert [len(next(steps)) for _ in range(6)] == [0, 1, 1, 1, 0, 0]
