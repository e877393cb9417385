"""Per-example scores as Column expressions over a packed token array.

`tokens` is array<struct<label_id int, logprob double, pred_id int, mu double,
sigma2 double>>, one element per position.  An example is one row, so none of
these needs a shuffle.  `label_id = -100` marks positions without loss; the
first position of a sequence has no prediction and so a null `logprob`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_INDEX = -100
EPSILON = 1e-10
MIN_VARIANCE = 1e-6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def _named(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is made once, however often `then` uses it: lambdas are
    interpreted, and inside of a condition Spark makes an array anew for each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def labelled_tokens(tokens: Column | str) -> Column:
    """Positions that carry loss."""
    return F.filter(tokens, lambda t: t["label_id"] != IGNORE_INDEX)


def scored_tokens(tokens: Column | str) -> Column:
    """Positions that carry loss, without the last of them (end of sequence)."""
    return _named(labelled_tokens(tokens), lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))


def avg_loss(tokens: Column | str) -> Column:
    """Mean negative log-probability; NaN without labelled tokens."""

    def mean(kept: Column) -> Column:
        total = _sum(F.transform(kept, lambda t: -t["logprob"]))
        return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(float("nan")))

    return _named(labelled_tokens(tokens), mean)


def prob_from_loss(loss: Column) -> Column:
    return F.exp(-loss)


def exact_memorization(tokens: Column | str) -> Column:
    """Share of scored tokens predicted right; null without any."""

    def share(kept: Column) -> Column:
        hits = _sum(F.transform(kept, lambda t: (t["pred_id"] == t["label_id"]).cast("double")))
        return F.when(F.size(kept) > 0, hits / F.size(kept))

    return _named(scored_tokens(tokens), share)


def correct_suffix_length(tokens: Column | str) -> Column:
    """Number of scored tokens after the last wrong prediction."""
    return _named(scored_tokens(tokens), _right_suffix)


def _right_suffix(kept: Column) -> Column:
    wrong_at = F.transform(
        kept, lambda t, i: F.when(t["pred_id"] != t["label_id"], i + 1).otherwise(0)
    )
    return F.size(kept) - F.coalesce(F.array_max(wrong_at), F.lit(0))


def extraction_strength(tokens: Column | str) -> Column:
    """Share of the longest right suffix, at least 1/n; 0 without tokens."""

    def share(kept: Column) -> Column:
        n = F.size(kept)
        return F.when(n > 0, F.greatest(_right_suffix(kept), F.lit(1)) / n).otherwise(F.lit(0.0))

    return _named(scored_tokens(tokens), share)


def bottom_k_mean(values: Column, k: float) -> Column:
    """Negated mean of the smallest `max(1, int(n*k))` values; 0 when empty."""

    def mean(given: Column) -> Column:
        n = F.size(given)
        take = F.greatest(F.lit(1), (n.cast("double") * F.lit(float(k))).cast("int"))
        lowest = F.slice(F.sort_array(given), F.lit(1), take)
        return F.when(n > 0, -_sum(lowest) / take).otherwise(F.lit(0.0))

    return _named(values, mean)


def min_k(tokens: Column | str, k: float = 0.2) -> Column:
    return bottom_k_mean(F.transform(scored_tokens(tokens), lambda t: t["logprob"]), k)


def min_k_plus_plus(tokens: Column | str, k: float = 0.2) -> Column:
    """Bottom-k mean of log-probabilities standardised by the vocabulary's moments."""
    z = F.transform(
        scored_tokens(tokens),
        lambda t: (t["logprob"] - t["mu"]) / F.sqrt(F.greatest(t["sigma2"], F.lit(MIN_VARIANCE))),
    )
    return bottom_k_mean(z, k)


def vocab_moments(vocab_logprobs: Column) -> Column:
    """struct(mu, sigma2) of a next-token distribution given as log-probabilities."""
    moments = F.aggregate(
        vocab_logprobs,
        F.struct(F.lit(0.0).alias("m1"), F.lit(0.0).alias("m2")),
        lambda acc, lp: F.struct(
            (acc["m1"] + F.exp(lp) * lp).alias("m1"),
            (acc["m2"] + F.exp(lp) * lp * lp).alias("m2"),
        ),
    )
    return F.struct(
        moments["m1"].alias("mu"),
        F.greatest(moments["m2"] - moments["m1"] * moments["m1"], F.lit(MIN_VARIANCE)).alias("sigma2"),
    )


def softmax_at(logits: Column, class_id: int = 0) -> Column:
    """Softmax probability of one class, shifted by the maximum for stability."""
    top = F.array_max(logits)
    total = _sum(F.transform(logits, lambda v: F.exp(v - top)))
    return F.exp(F.element_at(logits, class_id + 1) - top) / total


def options_prob(correct: Column, wrong_sum: Column) -> Column:
    return correct / (correct + wrong_sum + F.lit(EPSILON))


def truth_ratio(correct_loss: Column, wrong_loss: Column) -> Column:
    return F.exp(-wrong_loss) / (F.exp(-correct_loss) + F.lit(EPSILON))


def closer_to_one(ratio: Column) -> Column:
    """min(x, 1/x); a NaN ratio stays NaN."""
    inverse = F.lit(1.0) / (ratio + F.lit(EPSILON))
    return F.when(F.isnan(ratio), ratio).otherwise(F.least(ratio, inverse))


def true_better(ratio: Column) -> Column:
    return F.when(F.isnan(ratio), ratio).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - ratio))


TRUTH_RATIO_AGGREGATORS = {"closer_to_1_better": closer_to_one, "true_better": true_better}
