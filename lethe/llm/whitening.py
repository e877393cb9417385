"""Whitening of embeddings by eigenvectors in mixed precision.

The covariance is summed over all vectors in integers, so it is the same for
every partitioning, centred first, and rounded once.  Its eigenvectors are
taken in single precision and corrected by the matrix products of Ogita and
Aishima in extended precision: with R = I - X'X and S = X'AX, every pair of
well separated eigenvalues gives its correction in closed form, and each step
squares the error.  Where eigenvalues lie too close for that, the covariance is
restricted to their vectors, shifted by their mean, and solved on its own;
the vectors are turned accordingly and the products go on.

The only matrices on the driver are of the size (dimensions x dimensions).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table

SCALE = 64
LARGEST = 2.0**40  # of a scaled entry; sums of squares of so many fit decimal(38, 0)
EXACT = 2.0**53
DECIMALS = Decimal(10) ** 38
Wide = np.longdouble


# ---------------------------------------------------------------- eigenvectors


def _norm(a: np.ndarray) -> Wide:
    return np.sqrt((a * a).sum())


def orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, made so to the precision of their type."""
    return x + x @ ((np.eye(x.shape[1], dtype=Wide) - x.T @ x) / 2)


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, Wide, Wide]:
    """One step: better vectors, eigenvalues, the distance below which two of them
    count as one cluster, and the error that the step found in `x`."""
    one = np.eye(len(a), dtype=Wide)
    r = one - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # closer pairs than the root of the precision would get a correction of rounding errors
    near = 2 * (_norm(off) + _norm(a) * _norm(r)) + np.sqrt(np.finfo(Wide).eps) * _norm(a)
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > near
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    return x + x @ e, values, near, _norm(r) + _norm(off - np.diag(np.diag(off))) / _norm(a)


def clusters(values: np.ndarray, near: Wide) -> list[np.ndarray]:
    """Runs of two and more neighbours, in the order of `values`, that are not farther apart than `near`."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def sub_solved(a: np.ndarray, x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The vectors of one cluster, turned to the eigenvectors of the restricted, shifted matrix."""
    v = x[:, run]
    small = v.T @ (a @ v)
    small -= np.trace(small) / len(run) * (v.T @ v)
    size = np.abs(small).max()
    if not size:
        return v
    _, turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))
    return v @ orthogonal(turn.astype(Wide))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix in
    extended precision.  Steps go on while they at least halve the error."""
    a = np.asarray(a, dtype=Wide)
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a), dtype=Wide), np.eye(len(a), dtype=Wide)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    best, found = Wide(np.inf), (x, np.diag(x.T @ a @ x))
    while True:
        better, values, near, error = corrected(a, x)
        if error < best:
            found = x, values
        if not error < best / 2:
            break
        best, x = error, better
        for run in clusters(values, near):
            x[:, run] = sub_solved(a, x, run)
    x, values = found
    order = np.argsort(-values, kind="stable")
    return values[order] * size, orthogonal(x[:, order])


# ---------------------------------------------------------------- exact sums


def scaled(vectors: Iterable, dims: int, scale: int) -> np.ndarray:
    """floor(scale * entry) as whole doubles; shorter vectors filled up with zeros."""
    vectors = list(vectors)
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact y'y of whole doubles, as Python integers."""
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < EXACT:
        return (y.T @ y).astype(np.int64).astype(object)
    whole = y.astype(np.int64).astype(object)
    return whole.T @ whole


def _summer(scale: int):
    """(dimension, sum) of scaled entries and, as dimension -1, the number of rows, of one task."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: list[int] = []
        rows = 0
        for batch in batches:
            if len(batch):
                part = scaled(batch["v"], max(map(len, batch["v"])), scale)
                rows += len(part)
                sums += [0] * (part.shape[1] - len(sums))
                for i, s in enumerate(part.astype(np.int64).sum(0).tolist()):
                    sums[i] += s
        yield pd.DataFrame({"i": range(-1, len(sums)), "s": [Decimal(rows), *map(Decimal, sums)]})

    return total


def _multiplier(centre: list[int], scale: int):
    """(i, j, sum of products) of entries less `centre`, i <= j, of one task."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dims = len(centre)
        low = np.array(centre, dtype=np.float64)
        sums = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            sums = sums + gram(scaled(batch["v"], dims, scale) - low)
        i, j = np.triu_indices(dims)
        yield pd.DataFrame({"i": i, "j": j, "s": [Decimal(int(s)) for s in sums[i, j]]})

    return total


def _wide(top: int, bottom: int) -> Wide:
    value = Fraction(top, bottom)
    first = float(value)
    return Wide(first) + Wide(float(value - Fraction(first)))


@dataclass(frozen=True)
class Whitener:
    """What whitening needs: whole centre and rest of the mean (T / n), eigenvectors
    divided by the roots of their eigenvalues, shares of the trace."""

    n: int
    centre: list[int]
    rest: list[int]
    directions: np.ndarray
    vectors: np.ndarray
    explained: list[float]
    scale: int

    def apply(self, entries: np.ndarray) -> np.ndarray:
        """Whitened rows of scaled entries."""
        mean = np.array([float(Fraction(t, self.n)) for t in self.rest])
        return (entries - np.array(self.centre, dtype=np.float64) - mean) @ self.directions

    def deviations(self, entries: np.ndarray) -> list[Decimal | None]:
        """Sum over the dimensions of (n x - S)^2, exact; null beyond 38 digits."""
        y = entries - np.array(self.centre, dtype=np.float64)
        t = np.array(self.rest, dtype=np.float64)
        most = float(np.abs(y).max(initial=0))
        if max(most, float(np.abs(t).max(initial=0))) * most * y.shape[1] < EXACT:
            squares, crossed = (y * y).sum(1).astype(np.int64).tolist(), (y @ t).astype(np.int64).tolist()
        else:
            whole = y.astype(np.int64).astype(object)
            squares, crossed = (whole * whole).sum(1).tolist(), (whole @ np.array(self.rest, dtype=object)).tolist()
        fixed = sum(r * r for r in self.rest)
        exact = (Decimal(self.n * self.n * q - 2 * self.n * p + fixed) for q, p in zip(squares, crossed))
        return [d if d < DECIMALS else None for d in exact]


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Not null, and every entry neither null nor non-finite nor beyond `LARGEST` when scaled."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LARGEST, F.lit(False)))


def fit(vectors: DataFrame, components: int = 32, vector_col: str = "embedding", scale: int = SCALE) -> Whitener | None:
    """The whitener of all usable vectors; None when there are none.

    Sums are made in every task and added by Spark, d * (d + 1) / 2 of them reach
    the driver.  Components whose eigenvalue is zero, up to rounding, are left out.
    """
    kept = vectors.where(usable(F.col(vector_col), scale)).select(F.col(vector_col).alias("v"))
    sums = {r["i"]: int(r["s"]) for r in kept.mapInPandas(_summer(scale), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = sums.pop(-1, 0)
    if not n:
        return None
    dims = len(sums)
    centre = [(2 * sums[i] + n) // (2 * n) for i in range(dims)]
    rest = [sums[i] - n * centre[i] for i in range(dims)]
    products = kept.mapInPandas(_multiplier(centre, scale), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    covariance = np.zeros((dims, dims), dtype=Wide)
    for r in products.collect():
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = _wide(n * int(r["s"]) - rest[i] * rest[j], n * n)
    values, vectors_ = eigen(covariance)
    trace = np.trace(covariance)
    real = values > dims * np.finfo(np.float64).eps * values.max(initial=0)
    count = min(components, int(real.sum()))
    values, vectors_ = values[:count], vectors_[:, :count]
    return Whitener(
        n,
        centre,
        rest,
        (vectors_ / np.sqrt(values)).astype(np.float64),
        vectors_.astype(np.float64),
        [float(v / trace) for v in values],
        scale,
    )


def identity_error(vectors: DataFrame, whitener: Whitener, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all usable rows."""
    dims, count = whitener.directions.shape

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, squares = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = whitener.apply(scaled(batch["v"], dims, whitener.scale))
            sums += w.sum(0)
            squares += w.T @ w
        i, j = np.triu_indices(count)
        yield pd.DataFrame({"i": np.r_[np.full(count, -1), i], "j": np.r_[np.arange(count), j], "s": np.r_[sums, squares[i, j]]})

    kept = vectors.where(usable(F.col(vector_col), whitener.scale)).select(F.col(vector_col).alias("v"))
    found = {(r["i"], r["j"]): r["s"] for r in kept.mapInPandas(total, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = [found[-1, j] / whitener.n for j in range(count)]
    return max((abs(s / whitener.n - mean[i] * mean[j] - (i == j)) for (i, j), s in found.items() if i >= 0), default=0.0)


def whiten(
    vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(`id_col`, component, n, deviation, whitened, explained, identity_error): one row
    per usable vector and component.

    Entries count as floor(scale * entry); an offset common to all of them, like
    the one of the contract, changes no result.  `deviation` is the exact sum of
    (n x - S)^2 as decimal(38, 0), null beyond 38 digits.  Rows whose vector is
    null, or has a null, non-finite or scaled entry of 2**40 or more, are left
    out; shorter vectors count as filled up with zeros; null ids and repeated
    rows take part like others; other columns are not read.  An empty table, or
    one whose vectors are all the same, gives no rows, and directions without
    any spread give no component.
    """
    whitener = fit(vectors, components, vector_col, scale)
    result = f"`{id_col}` bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if whitener is None or not whitener.explained:
        return vectors.sparkSession.createDataFrame([], result)
    error = identity_error(vectors, whitener, vector_col)
    dims = len(whitener.centre)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries = scaled(batch["v"], dims, scale)
            yield batch[["id", "named"]].assign(deviation=whitener.deviations(entries), w=list(whitener.apply(entries)))

    # a null id would turn the ids of its batch into doubles
    number = F.col(id_col).cast("bigint")
    kept = vectors.where(usable(F.col(vector_col), scale)).select(
        F.coalesce(number, F.lit(0)).alias("id"), number.isNotNull().alias("named"), F.col(vector_col).alias("v")
    )
    rows = kept.mapInPandas(apply, "id bigint, named boolean, deviation decimal(38,0), w array<double>").withColumn("id", F.when(F.col("named"), F.col("id")))
    shares = F.array(*[F.lit(x) for x in whitener.explained])
    spread = rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return spread.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(whitener.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query("op11_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    """`deviation` is a long by contract; where the sum is beyond one it is null and
    stands in `deviation_exact` alone."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
