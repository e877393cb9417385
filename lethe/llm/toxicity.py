"""A toxicity classifier regularised by counterfactual pairs.

A logistic model over hashed words and word beginnings learns from labelled
texts.  In sentences that mention a group, the mention is swapped for another of
its kind; the penalty is the squared change of the score.  The same penalty
holds for a mention on its own, so that the model gives none to neutral groups.

The model is fitted in one task on at most `max_rows` labelled rows, chosen by a
hash of their id; every row is scored, in one narrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table

MAX_ROWS = 8_000
BITS = 18
STEMS = (4, 5, 6)
KEPT_WORDS = 300_000
ROUNDS = 200
L1 = 2e-4
SWAP_WEIGHT = 1.0
RARE = 4  # features in fewer rows are not learnt

# Neutral mentions of groups, by kind; a mention may be swapped for another of its line.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


class Features(dict):
    """Feature numbers of each word met so far: the word and its beginnings.

    With `useful`, numbers whose entry is false are left out.
    """

    def __init__(self, useful: np.ndarray | None = None):
        self.useful = useful

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]
        found = tuple(xxhash.xxh3_64_intdigest(p) & ((1 << BITS) - 1) for p in parts)
        if self.useful is not None:
            found = tuple(f for f in found if self.useful[f])
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        return set(chain.from_iterable(map(self.__getitem__, set(WORD.findall(text.lower())))))


def swaps(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    """Each mention and the one it is swapped for: the next of its line."""
    return {term: line[(i + 1) % len(line)] for line in groups for i, term in enumerate(line)}


def counterfactuals(text: str, pattern: re.Pattern, other: dict[str, str], features: Features) -> list[tuple[list[int], list[int]]]:
    """For each sentence with a mention: features lost and gained by the swap."""
    out = []
    if pattern.search(text):
        for sentence in SENTENCE.findall(text):
            swapped, n = pattern.subn(lambda m: other[m[0].lower()], sentence)
            if n:
                before, after = features.of(sentence), features.of(swapped)
                out.append((sorted(before - after), sorted(after - before)))
    return out


def _mention(groups: Sequence[Sequence[str]]) -> re.Pattern:
    terms = sorted(chain.from_iterable(groups), key=len, reverse=True)
    return re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b", re.IGNORECASE) if terms else re.compile(r"(?!)")


def _extractor(groups: Sequence[Sequence[str]]):
    def extract(batches):
        features, pattern, other = Features(), _mention(groups), swaps(groups)
        for batch in batches:
            rows = [
                (y, sorted(features.of(text)), [{"lost": a, "gained": b} for a, b in counterfactuals(text, pattern, other, features)])
                for y, text in zip(batch["y"], batch["text"])
            ]
            yield pd.DataFrame(rows, columns=["y", "x", "pairs"])

    return extract


class Rows:
    """A sparse matrix of small numbers of non-zero entries per row."""

    def __init__(self, rows: Sequence[Sequence[int]], signs: Sequence[Sequence[float]] | None, width: int):
        self.width, self.n = width, len(rows)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.col = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if self.n else np.empty(0, np.int32)
        self.value = np.concatenate([np.asarray(s, dtype=np.float64) for s in signs]) if signs else None

    def times(self, w: np.ndarray) -> np.ndarray:
        v = w[self.col]
        return np.bincount(self.row, v if self.value is None else v * self.value, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        v = g[self.row]
        return np.bincount(self.col, v if self.value is None else v * self.value, self.width)


def fit(
    y: np.ndarray,
    x: Sequence[Sequence[int]],
    pairs: Sequence[tuple[Sequence[int], Sequence[int]]],
    swap_weight: float = SWAP_WEIGHT,
    l1: float = L1,
    rounds: int = ROUNDS,
    width: int = 1 << BITS,
) -> tuple[np.ndarray, float]:
    """Weights and intercept: weighted logistic loss, squared score change over
    `pairs`, and an L1 term, by accelerated proximal steps.

    With one class only, or no rows, all weights are zero and the intercept is
    the log odds of the classes, each counted once more than seen.
    """
    y = np.asarray(y, dtype=np.float64)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    w, best = np.zeros(width), prior
    if not len(y) or y.min() == y.max():
        return w, best
    data = Rows(x, None, width)
    seen = np.bincount(data.col, minlength=width)
    use = seen >= RARE
    keep = use[data.col]
    data.row, data.col = data.row[keep], data.col[keep]
    change = Rows([[*a, *b] for a, b in pairs], [[1.0] * len(a) + [-1.0] * len(b) for a, b in pairs], width)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    scale = swap_weight / max(1, change.n)

    def step(v: np.ndarray) -> np.ndarray:
        return 0.25 * data.back(weight * data.times(v)) + 2 * scale * change.back(change.times(v))

    probe = np.random.default_rng(3).random(width) * use
    for _ in range(15):  # the largest eigenvalue, by powers
        size = np.linalg.norm(probe)
        if not size:
            break
        probe = step(probe / size)
    rate = 1.0 / (1.1 * np.linalg.norm(probe) + 0.5)
    b, ahead, ahead_b, momentum = 0.0, w.copy(), 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(data.times(ahead) + ahead_b)))
        error = weight * (p - y)
        moved = ahead - rate * (data.back(error) + 2 * scale * change.back(change.times(ahead)))
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
        new_b = ahead_b - rate * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_b = new + (momentum - 1) / following * (new - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new, new_b, following
    return w, float(b)


def _fitter(groups, swap_weight, l1, rounds):
    def fit_group(rows: pd.DataFrame) -> pd.DataFrame:
        features = Features()
        pairs = [(p["lost"], p["gained"]) for row in rows["pairs"] for p in row]
        pairs += [(sorted(features.of(term)), []) for term in swaps(groups)]
        w, b = fit(rows["y"].to_numpy(), rows["x"].tolist(), pairs, swap_weight, l1, rounds)
        used = np.flatnonzero(w)
        return pd.DataFrame({"feature": [[*used.tolist()]], "weight": [[*w[used].tolist()]], "intercept": [b]})

    return fit_group


def train(
    labelled: DataFrame,
    max_rows: int = MAX_ROWS,
    groups: Sequence[Sequence[str]] = GROUPS,
    swap_weight: float = SWAP_WEIGHT,
    l1: float = L1,
    rounds: int = ROUNDS,
) -> tuple[np.ndarray, float]:
    """Fit on the rows of `labelled` (y int, text string); the caller has bounded them.

    Returns weights and intercept.  An empty table gives a model that scores 0.5.
    """
    rows = labelled.limit(max_rows).mapInPandas(
        _extractor(groups), "y int, x array<int>, pairs array<struct<lost:array<int>,gained:array<int>>>"
    )
    fitted = (
        rows.groupBy(F.lit(0).alias("all"))
        .applyInPandas(_fitter(groups, swap_weight, l1, rounds), "feature array<int>, weight array<double>, intercept double")
        .collect()
    )
    w = np.zeros(1 << BITS)
    if not fitted:
        return w, 0.0
    w[fitted[0]["feature"]] = fitted[0]["weight"]
    return w, fitted[0]["intercept"]


def labelled_rows(
    docs: DataFrame, labels: DataFrame, label: str, train_on, max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(y, text) of at most `max_rows` labelled documents where `train_on` holds,
    those with the smallest hashes of their id."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & train_on)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # at most max_rows ids; a repeated document is one example
    return (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id")
        .agg(F.first("y").alias("y"), F.min("text").alias("text"))
        .select("y", "text")
    )


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A column function from a text to its score; a null text scores as an empty one."""
    weights, intercept = model
    used = np.flatnonzero(weights)
    shipped = spark.sparkContext.broadcast((used, weights[used], intercept))  # at most 2**BITS weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        used, values, intercept = shipped.value
        w = np.zeros(1 << BITS)
        w[used] = values
        features = Features(w != 0)
        for batch in batches:
            z = [intercept + sum(w[f] for f in sorted(features.of(text))) for text in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -500, 500))))

    return lambda text: run(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, score) for every row; null and empty texts get the intercept's score.

    Null and repeated ids are carried along; other columns are not read.
    """
    return docs.select(id_col, scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that score below `threshold`."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < threshold)


def held_out(id_col: str = "doc_id"):
    """True for one id in five; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@query("op3_toxicity")
def toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(labelled_rows(docs, labels, "toxic", ~held_out(), MAX_ROWS))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
