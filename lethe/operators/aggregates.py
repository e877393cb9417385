"""Aggregates over per-example scores.

All of them aggregate partially before the shuffle; a hot run or metric costs
one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import scores as S
from lethe.functions.ks import ks_pvalue
from lethe.operators.order import running_sums
from lethe.session import materialise


class AlignmentError(ValueError):
    """Two result sets do not hold the same examples."""


def losses_from_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """avg_loss and prob per example from a table with one row per token.

    Tokens of an example collapse on the map side, so one row per example and
    task is shuffled and an example of any length is fine.
    """
    labelled = F.col("label_id") != S.IGNORE_INDEX
    sums = tokens.groupBy(*keys).agg(
        F.sum(F.when(labelled, -F.col("logprob"))).alias("_loss"), F.count(F.when(labelled, 1)).alias("_n")
    )
    loss = F.when(F.col("_n") > 0, F.coalesce("_loss", F.lit(0.0)) / F.greatest("_n", F.lit(1))).otherwise(
        F.lit(float("nan"))
    )
    return sums.select(*keys, loss.alias("avg_loss")).withColumn("prob", S.prob_from_loss(F.col("avg_loss")))


def memorization_from_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact memorization per example from one row per token; the last labelled
    token is taken out again by its own hit."""
    kept = tokens.where(F.col("label_id") != S.IGNORE_INDEX).withColumn(
        "_hit", (F.col("pred_id") == F.col("label_id")).cast("int")
    )
    sums = kept.groupBy(*keys).agg(
        F.sum("_hit").alias("_hits"), F.count("*").alias("_n"), F.max_by("_hit", "pos").alias("_last")
    )
    return sums.where(F.col("_n") > 1).select(
        *keys, ((F.col("_hits") - F.col("_last")) / (F.col("_n") - 1)).alias("score")
    )


def pack_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per example with its tokens as an array in position order.

    An array is as long as the model's context at most.
    """
    fields = [c for c in tokens.columns if c not in keys and c != "pos"]
    packed = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_t"))
    return packed.select(
        *keys, F.transform("_t", lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias("tokens")
    )


def mean_over_answers(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """One value per example: the mean over its answers."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def two_level_mean(
    df: DataFrame, value: str, example: Sequence[str] = ("index",), group: Sequence[str] = (), name: str = "agg_value"
) -> DataFrame:
    """Mean over answers within an example, then over examples.

    Null scores are left out (as `avg` does; a filter on the score would be
    pushed below its computation and run it twice); NaN is kept.
    """
    per_example = mean_over_answers(df, value, [*group, *example])
    return per_example.groupBy(*group).agg(F.avg(value).alias(name))


def transpose_answers(df: DataFrame, stats: Sequence[str], keys: Sequence[str] = ("index",)) -> DataFrame:
    """One row per example with a list per statistic, in answer order.

    A list is as long as the example has answers.
    """
    listed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("answer_idx", *stats))).alias("_answers")
    )
    return listed.select(*keys, *[F.col(f"_answers.{s}").alias(s) for s in stats])


def duplicate_indices(df: DataFrame, keys: Sequence[str] = ("answer_idx", "index")) -> DataFrame:
    """Keys that occur more than once; empty for a sound result set."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        sides.groupBy(*keys)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .where(F.col("_l") + F.col("_r") == 1)
        .select(*keys, F.when(F.col("_l") == 1, "left").otherwise("right").alias("only_in"))
    )


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Inner join of two result sets that must hold the same keys."""
    if check:
        extra = unmatched_keys(left, right, keys).take(1)
        if extra:
            raise AlignmentError(f"result sets differ, e.g. at {extra[0].asDict()}")
    return left.join(right, list(keys))


def _answer_sides(df: DataFrame, keys: Sequence[str], right: Column, **aggregates: Column) -> DataFrame:
    """Per example an aggregate over its right and one over its wrong answers, in one
    grouping; an example without either is an error, raised where it is computed."""
    sums = df.groupBy(*keys).agg(
        F.count(F.when(right, 1)).alias("_right"),
        F.count(F.when(~right, 1)).alias("_wrong_rows"),
        *[made.alias(name) for name, made in aggregates.items()],
    )
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    complete = (F.col("_right") > 0) & (F.col("_wrong_rows") > 0)
    problem = F.raise_error(F.concat(F.lit("result sets differ, e.g. at "), shown)).cast("double")
    return sums.select(*keys, *[F.when(complete, F.col(name)).otherwise(problem).alias(name) for name in aggregates])


def prob_with_options(answers: DataFrame, keys: Sequence[str] = ("index",), right: Column | None = None) -> DataFrame:
    """Probability of the right answer among all options, per example.

    `answers` holds right and wrong answers; `right` tells them apart and is
    `answer_idx = 0` by default.
    """
    right = F.col("answer_idx") == 0 if right is None else right
    sides = _answer_sides(
        answers, keys, right, _correct=F.avg(F.when(right, F.col("prob"))), _wrong=F.sum(F.when(~right, F.col("prob")))
    )
    return sides.select(*keys, S.options_prob(F.col("_correct"), F.col("_wrong")).alias("prob"))


def truth_ratio_scores(answers: DataFrame, keys: Sequence[str] = ("index",), right: Column | None = None) -> DataFrame:
    """Truth ratio per example; answers are averaged on their losses first."""
    right = F.col("answer_idx") == 0 if right is None else right
    sides = _answer_sides(
        answers, keys, right, _correct=F.avg(F.when(right, F.col("avg_loss"))), _wrong=F.avg(F.when(~right, F.col("avg_loss")))
    )
    return sides.select(*keys, S.truth_ratio(F.col("_correct"), F.col("_wrong")).alias("score"))


def truth_ratio_agg(ratios: DataFrame, aggregator: str, group: Sequence[str] = (), name: str = "agg_value") -> DataFrame:
    try:
        shape = S.TRUTH_RATIO_AGGREGATORS[aggregator]
    except KeyError:
        raise ValueError(f"unknown truth ratio aggregator {aggregator!r}") from None
    return ratios.groupBy(*group).agg(F.avg(shape(F.col("score"))).alias(name))


def _two_sample_counts(df: DataFrame, group: Sequence[str], score: str, first: Column) -> DataFrame:
    """Rows per distinct score of each of two samples.

    Stored, because ordering reads it three times and scores are costly to make.
    """
    counts = df.groupBy(*group, score).agg(
        F.sum(first.cast("long")).alias("n_a"), F.sum((~first).cast("long")).alias("n_b")
    )
    return materialise(counts, "score-counts")


def roc_auc(
    df: DataFrame, group: Sequence[str] = (), score: str = "score", population: str = "population", positive: str = "holdout"
) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with an empty population.

    Scores are counted per distinct value first, so ties never straddle buckets.
    """
    counts = _two_sample_counts(df, group, score, F.col(population) != positive)
    ranked = running_sums(counts, score, ["n_a"], group)
    wide = "decimal(38,0)"
    below = F.col("n_b").cast(wide) * (2 * F.col("n_a_before") + F.col("n_a")).cast("decimal(20,0)")
    sums = ranked.groupBy(*group).agg(
        F.sum("n_a").alias("n_members"),
        F.sum("n_b").alias("n_others"),
        F.sum(below.cast(wide)).alias("_twice_u"),
    )
    pairs = F.col("n_members").cast("double") * F.col("n_others").cast("double")
    return sums.select(
        *group,
        "n_members",
        "n_others",
        F.when(pairs > 0, F.col("_twice_u").cast("double") / (2 * pairs)).alias("auc"),
    )


def ks_statistic(
    df: DataFrame, group: Sequence[str] = (), score: str = "score", sample: str = "run", first: str = "target"
) -> DataFrame:
    """Two-sample KS: sizes, the exact integer max |c1*n2 - c2*n1| and D."""
    group = list(group)
    counts = _two_sample_counts(df, group, score, F.col(sample) == first)
    ranked = running_sums(counts, score, ["n_a", "n_b"], group, totals=True)
    big = "decimal(19,0)"
    c1 = (F.col("n_a_before") + F.col("n_a")).cast(big)
    c2 = (F.col("n_b_before") + F.col("n_b")).cast(big)
    gap = F.abs(c1 * F.col("n_b_total").cast(big) - c2 * F.col("n_a_total").cast(big))
    found = ranked.groupBy(*group).agg(
        F.max("n_a_total").alias("n1"), F.max("n_b_total").alias("n2"), F.max(gap).alias("gap")
    )
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    return found.where(both).select(
        *group,
        "n1",
        "n2",
        F.col("gap").cast("decimal(38,0)").alias("gap"),
        (F.col("gap").cast("double") / (F.col("n1").cast("double") * F.col("n2").cast("double"))).alias("statistic"),
    )


def ks_test(
    df: DataFrame, group: Sequence[str] = (), score: str = "score", sample: str = "run", first: str = "target", method: str = "exact"
) -> DataFrame:
    """KS statistic with its two-sided p-value and `p_method`, one row per group.

    The method is the caller's choice and never depends on the sizes: "exact"
    walks through a band of the width of the gap where the samples differ in size,
    "limit" costs nothing.
    """
    found = ks_statistic(df, group, score, sample, first)
    if group:
        # one p-value may take long: spread the groups over the cores
        found = found.repartition(df.sparkSession.sparkContext.defaultParallelism, *group)
    p = ks_pvalue(F.col("gap").cast("string"), F.col("n1"), F.col("n2"), method)
    return found.withColumn("p_value", p).withColumn("p_method", F.lit(method))


def ks_test_reciprocal(
    df: DataFrame, group: Sequence[str] = (), score: str = "score", sample: str = "run", first: str = "target", method: str = "exact"
) -> DataFrame:
    flipped = df.withColumn(score, F.lit(1.0) / (F.col(score) + F.lit(S.EPSILON)))
    return ks_test(flipped, group, score, sample, first, method)


def attack_summary(df: DataFrame, group: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Mean attack score and size per population."""
    return df.groupBy(*group, "population").agg(F.avg(score).alias("agg_value"), F.count("*").alias("n_examples"))


def union_populations(forget: DataFrame, holdout: DataFrame) -> DataFrame:
    """Both populations with the label 0 for forget and 1 for holdout."""
    return forget.withColumn("population", F.lit("forget")).withColumn("label", F.lit(0)).unionByName(
        holdout.withColumn("population", F.lit("holdout")).withColumn("label", F.lit(1))
    )


def privleak(score: Column, reference: Column, ref_value: float = 0.5) -> Column:
    """Relative gap of 1-AUC in percent; the default stands in for a missing reference."""
    s = F.lit(1.0) - score
    r = F.lit(1.0) - F.coalesce(reference, F.lit(float(ref_value)))
    return (s - r) / (r + F.lit(S.EPSILON)) * F.lit(100.0)


def rel_diff(score: Column, reference: Column, ref_value: float = 0.5) -> Column:
    r = F.coalesce(reference, F.lit(float(ref_value)))
    return (score - r) / (r + F.lit(S.EPSILON)) * F.lit(100.0)


def harmonic_mean(df: DataFrame, value: str = "agg_value", group: Sequence[str] = (), name: str = "agg_value") -> DataFrame:
    """Harmonic mean; 0 if any value is 0; an error on a null or negative value."""
    v = F.col(value)
    checked = F.when(
        v.isNull() | (v < 0), F.raise_error(F.lit("harmonic mean needs values of at least 0")).cast("double")
    ).otherwise(v)
    good = df.withColumn("_v", checked)
    return good.groupBy(*group).agg(
        F.when(F.min("_v") == 0, F.lit(0.0))
        .otherwise(F.count("*") / F.sum(F.lit(1.0) / F.when(F.col("_v") != 0, F.col("_v"))))
        .alias(name)
    )


def reference_scores(target: DataFrame, reference: DataFrame, keys: Sequence[str] = ("index", "answer_idx")) -> DataFrame:
    """Loss of the target model minus that of the reference model.

    Both models have to be scored on the same examples: one that only either of
    them has is an error, raised inside the join.
    """
    own = target.withColumn("_own", F.lit(True))
    ref = reference.select(*keys, F.col("avg_loss").alias("_reference"), F.lit(True).alias("_other"))
    met = own.join(ref, list(keys), "full")
    alone = F.col("_own").isNull() | F.col("_other").isNull()
    lost = F.raise_error(F.concat(F.lit("example without both models' losses: "), F.to_json(F.struct(*keys)))).cast("double")
    score = F.when(alone, lost).otherwise(F.col("avg_loss") - F.col("_reference"))
    return met.withColumn("score", score).drop("_reference", "_own", "_other")


def gradnorm_scores(norms: DataFrame, keys: Sequence[str] = ("population", "index"), p: float = 2) -> DataFrame:
    """Mean gradient norm over parameters.  `norms` has a column `p` with the norm used."""
    if p not in (1, 2, float("inf")):
        raise ValueError(f"gradient norm {p} is not one of 1, 2, inf")
    return norms.where(F.col("p") == F.lit(float(p))).groupBy(*keys).agg(F.avg("norm").alias("score"))
