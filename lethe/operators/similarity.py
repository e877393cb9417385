"""Overlap scores between generated text and ground truth."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions import scores as S
from lethe.functions.stem import porter_stem

ROUGE_TYPES = ("rouge1_recall", "rougeL_f1", "rougeL_recall")
STEM_LONGER_THAN = 3


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, as an array."""
    return F.filter(F.split(_cleaned(text), " "), lambda w: w != "")


def _cleaned(text: Column) -> Column:
    """The same tokens as one text: a batch of rows is held as text, and one row's words at a time."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence: one row of the table kept as bits of an integer."""
    positions: dict[str, int] = {}
    for i, word in enumerate(a):
        positions[word] = positions.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        match = row & positions.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _scores(reference: Sequence[str], generated: Sequence[str]) -> tuple[float, float, float]:
    n_ref, n_gen = len(reference), len(generated)
    if not n_ref or not n_gen:
        return 0.0, 0.0, 0.0
    overlap = (Counter(reference) & Counter(generated)).total()
    lcs = lcs_length(reference, generated)
    recall, precision = lcs / n_ref, lcs / n_gen
    f1 = 2 * precision * recall / (precision + recall) if lcs else 0.0
    return overlap / n_ref, f1, recall


_ROUGE = T.StructType([T.StructField(name, T.DoubleType()) for name in ROUGE_TYPES])


def _rouge_frame(references: pd.Series, generated: pd.Series, stem: bool) -> pd.DataFrame:
    stems: dict[str, str] = {}  # distinct words of the batch are stemmed once

    def stemmed(word: str) -> str:
        if word not in stems:
            stems[word] = porter_stem(word) if len(word) > STEM_LONGER_THAN else word
        return stems[word]

    def prepared(text: str) -> list[str]:
        return [stemmed(w) for w in text.split()] if stem else text.split()

    rows = [_scores(prepared(r), prepared(g)) for r, g in zip(references, generated)]
    return pd.DataFrame(rows, columns=list(ROUGE_TYPES))


@F.pandas_udf(_ROUGE)
def _rouge_stemmed(references: pd.Series, generated: pd.Series) -> pd.DataFrame:
    return _rouge_frame(references, generated, True)


@F.pandas_udf(_ROUGE)
def _rouge_plain(references: pd.Series, generated: pd.Series) -> pd.DataFrame:
    return _rouge_frame(references, generated, False)


def text_similarity(df: DataFrame, use_stemmer: bool = True) -> DataFrame:
    """Add the three ROUGE scores to rows with `ground_truth` and `generation`.

    Each row is scored on its own: no shuffle, whole texts.
    """
    score = _rouge_stemmed if use_stemmer else _rouge_plain
    scored = df.withColumn(
        "_rouge", score(_cleaned(F.col("ground_truth")), _cleaned(F.col("generation")))
    )
    return scored.select(*df.columns, *[F.col(f"_rouge.{name}").alias(name) for name in ROUGE_TYPES])


def attach_classifier_scores(
    generations: DataFrame, logits: DataFrame, class_id: int = 0, keys: Sequence[str] = ("index",)
) -> DataFrame:
    """Score the texts of an earlier metric with classifier logits, by example.

    Every text needs logits and every row of logits its text: one that is alone is
    an error, raised inside the join.
    """
    scores = logits.select(*keys, S.softmax_at(F.col("logits"), class_id).alias("_score"), F.lit(True).alias("_scored"))
    met = generations.withColumn("_text", F.lit(True)).join(scores, list(keys), "full")
    alone = F.col("_text").isNull() | F.col("_scored").isNull()
    lost = F.raise_error(F.concat(F.lit("example without text or logits: "), F.to_json(F.struct(*keys)))).cast("double")
    return met.withColumn("score", F.when(alone, lost).otherwise(F.col("_score"))).drop("_score", "_scored", "_text")
