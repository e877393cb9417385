"""The built-in metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import scores as S
from lethe.functions.text import cut_at_stopwords
from lethe.metrics.registry import Inputs, Result, TokenScores, metric
from lethe.operators import aggregates as A
from lethe.operators.similarity import ROUGE_TYPES, attach_classifier_scores, text_similarity
from lethe.operators.tokens import zlib_score

EXAMPLE = ["index", "answer_idx"]
TOK = "tokens"


def _mean(values: DataFrame, stat: str) -> Result:
    return Result(lambda v: A.two_level_mean(v, stat), values)


def _flat_mean(stat: str):
    return lambda v: v.agg(F.avg(stat).alias("agg_value"))


def _auc(values: DataFrame) -> DataFrame:
    return A.roc_auc(values).select(F.col("auc").alias("agg_value"))


# Token tables come with one row per token or packed with one row per example
# (a column `tokens`), or as scores that the runner took from them for the whole
# suite (`score`, or `avg_loss` and `prob`).

LOSS_FIELDS, MATCH_FIELDS = ("label_id", "logprob"), ("label_id", "pred_id")


def _packed(df: DataFrame) -> DataFrame:
    return df if TOK in df.columns else A.pack_tokens(df, EXAMPLE)


def _loss_columns() -> dict[str, Column]:
    return {"avg_loss": S.avg_loss(TOK), "prob": S.prob_from_loss(S.avg_loss(TOK))}


LOSSES = TokenScores(LOSS_FIELDS, lambda: _loss_columns())


def _losses(df: DataFrame) -> DataFrame:
    if "avg_loss" in df.columns:
        return df
    if TOK not in df.columns:
        return A.losses_from_tokens(df, EXAMPLE)
    losses = df.select(*EXAMPLE, S.avg_loss(TOK).alias("avg_loss"))
    return losses.withColumn("prob", S.prob_from_loss(F.col("avg_loss")))


def _scored(df: DataFrame, score: Column) -> DataFrame:
    return df.select(*EXAMPLE, "score") if "score" in df.columns else _packed(df).select(*EXAMPLE, score.alias("score"))


@metric(tokens=LOSSES)
def probability(inputs: Inputs) -> Result:
    return _mean(_losses(inputs.only()), "prob")


def _right_and_wrong(inputs: Inputs) -> tuple[DataFrame, Column]:
    """Both stored result sets in one table, and what tells them apart."""
    parts = inputs.pre_compute
    correct, wrong = (parts[p].values.withColumn("_correct_part", F.lit(p == "correct")) for p in ("correct", "wrong"))
    return correct.unionByName(wrong, allowMissingColumns=True), F.col("_correct_part")


@metric()
def probability_w_options(inputs: Inputs) -> Result:
    answers, right = _right_and_wrong(inputs)
    values = A.prob_with_options(answers, right=right)
    return Result(_flat_mean("prob"), values)


@metric()
def rouge(inputs: Inputs, rouge_type: str, stopwords: tuple[str, ...] = (), eos: str = "", use_stemmer: bool = True) -> Result:
    if rouge_type not in ROUGE_TYPES:
        raise ValueError(f"rouge type {rouge_type!r} is none of {ROUGE_TYPES}")
    cut = inputs.only().withColumn("generation", cut_at_stopwords(F.col("generation"), stopwords, eos))
    return _mean(text_similarity(cut, use_stemmer), rouge_type)


@metric()
def truth_ratio(inputs: Inputs, aggregator: str) -> Result:
    answers, right = _right_and_wrong(inputs)
    values = A.truth_ratio_scores(answers, right=right)
    return Result(lambda v: A.truth_ratio_agg(v, aggregator), values)


@metric(tokens=TokenScores(MATCH_FIELDS, lambda: {"score": S.exact_memorization(TOK)}))
def exact_memorization(inputs: Inputs) -> Result:
    df = inputs.only()
    if TOK in df.columns or "score" in df.columns:
        return _mean(_scored(df, S.exact_memorization(TOK)), "score")
    return _mean(A.memorization_from_tokens(df, EXAMPLE), "score")


@metric(tokens=TokenScores(MATCH_FIELDS, lambda: {"score": S.extraction_strength(TOK)}))
def extraction_strength(inputs: Inputs) -> Result:
    return _mean(_scored(inputs.only(), S.extraction_strength(TOK)), "score")


def _attack(inputs: Inputs, score) -> Result:
    """Score both populations, then the area under the curve over them."""
    scored = {role: score(df) for role, df in inputs.data.items() if role in ("forget", "holdout")}
    values = A.union_populations(scored["forget"], scored["holdout"]).drop("label")
    return Result(_auc, values)


def _token_attack(inputs: Inputs, score: Column) -> Result:
    return _attack(inputs, lambda df: _scored(df, score))


@metric(tokens=LOSSES)
def mia_loss(inputs: Inputs) -> Result:
    return _attack(inputs, lambda df: _losses(df).select(*EXAMPLE, F.col("avg_loss").alias("score")))


@metric(tokens=TokenScores(LOSS_FIELDS, lambda k=0.2: {"score": S.min_k(TOK, k)}))
def mia_min_k(inputs: Inputs, k: float = 0.2) -> Result:
    return _token_attack(inputs, S.min_k(TOK, k))


@metric("mia_min_k_plus_plus", TokenScores((*LOSS_FIELDS, "mu", "sigma2"), lambda k=0.2: {"score": S.min_k_plus_plus(TOK, k)}))
def mia_min_k_pp(inputs: Inputs, k: float = 0.2) -> Result:
    return _token_attack(inputs, S.min_k_plus_plus(TOK, k))


def _zlib() -> Column:
    return zlib_score(S.avg_loss(TOK), F.array_join(S.labelled_tokens(TOK)["word"], " "))


@metric(tokens=TokenScores((*LOSS_FIELDS, "word"), lambda: {"score": _zlib()}))
def mia_zlib(inputs: Inputs) -> Result:
    """Tokens carry `word`, the text of their label."""
    return _token_attack(inputs, _zlib())


@metric(tokens=LOSSES)
def mia_reference(inputs: Inputs) -> Result:
    """`forget_reference` and `holdout_reference` are the reference model's tokens."""

    def score(role: str) -> DataFrame:
        own, other = (_losses(inputs.data[r]) for r in (role, f"{role}_reference"))
        return A.reference_scores(own, other, EXAMPLE).select(*EXAMPLE, "score")

    values = A.union_populations(score("forget"), score("holdout")).drop("label")
    return Result(_auc, values)


@metric()
def mia_gradnorm(inputs: Inputs, p: float = 2) -> Result:
    return _attack(inputs, lambda df: A.gradnorm_scores(df, ["index"], p))


@metric()
def ks_test(inputs: Inputs) -> Result:
    own = inputs.pre_compute["forget"].values.select("score", F.lit("target").alias("run"))
    reference = inputs.reference.get("retain")
    if reference is None or reference.values is None:
        return Result(_null_row(own))
    both = own.unionByName(reference.values.select("score", F.lit("retain").alias("run")))
    return Result(A.ks_test(both).select(F.col("p_value").alias("agg_value")))


def _null_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(None,)], "agg_value double")


def _against_reference(inputs: Inputs, formula, ref_value: float) -> Result:
    own = inputs.pre_compute["forget"].aggregate()
    reference = inputs.reference.get("retain")
    ref = reference.aggregate() if reference is not None else _null_row(own)
    return Result(own.select(formula(F.col("agg_value"), ref.select("agg_value").scalar(), ref_value).alias("agg_value")))


@metric()
def privleak(inputs: Inputs, ref_value: float = 0.5) -> Result:
    return _against_reference(inputs, A.privleak, ref_value)


@metric()
def rel_diff(inputs: Inputs, ref_value: float = 0.5) -> Result:
    return _against_reference(inputs, A.rel_diff, ref_value)


@metric()
def hm_aggregate(inputs: Inputs) -> Result:
    rows = [r.aggregate().select("agg_value") for r in inputs.pre_compute.values()]
    return Result(A.harmonic_mean(reduce(DataFrame.unionByName, rows)))


@metric()
def classifier_prob(inputs: Inputs, class_id: int = 0, text_key: str = "generation") -> Result:
    """`logits` holds the classifier's output per example of the earlier metric."""
    text = inputs.pre_compute["text"].values.select(*EXAMPLE, F.col(text_key).alias("text"))
    values = attach_classifier_scores(text, inputs.data["logits"], class_id, EXAMPLE)
    return Result(_flat_mean("score"), values)
