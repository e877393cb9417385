import math

import pytest
from pyspark.sql import functions as F

from lethe.functions import scores as S
from lethe.operators import aggregates as A
from lethe.operators.tokens import target_words

TOKENS = "array<struct<label_id:int,logprob:double,pred_id:int,mu:double,sigma2:double>>"


def example(pattern, prompt=2, logprobs=None):
    """A prompt, one token per mark (1 = predicted right), and the end mark."""
    body = [(7, (logprobs or [-1.0] * len(pattern))[i], 7 if ok else 8, -2.0, 0.25) for i, ok in enumerate(pattern)]
    return [(-100, None, 1, None, None)] * prompt + body + [(2, -3.0, 2, -1.0, 0.0)]


def one(spark, tokens, column):
    return spark.createDataFrame([(tokens,)], f"tokens {TOKENS}").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "pattern,strength,exact",
    [((1, 0, 1, 1), 0.5, 0.75), ((1, 1, 0), 1 / 3, 2 / 3), ((1, 1, 1), 1.0, 1.0), ((), 0.0, None), ((0,), 1.0, 0.0)],
)
def test_memorization(spark, pattern, strength, exact):
    tokens = example(pattern)
    assert one(spark, tokens, S.extraction_strength("tokens")) == pytest.approx(strength)
    found = one(spark, tokens, S.exact_memorization("tokens"))
    assert found is None if exact is None else found == pytest.approx(exact)


def test_loss_counts_the_end_mark_and_is_nan_without_labels(spark):
    assert one(spark, example((1, 1)), S.avg_loss("tokens")) == pytest.approx(5 / 3)
    assert math.isnan(one(spark, [(-100, None, 1, None, None)], S.avg_loss("tokens")))


def test_bottom_k(spark):
    values = F.array(*[F.lit(v) for v in (-1.0, -4.0, -0.5, -3.0, -2.0)])
    row = spark.range(1).select(
        S.bottom_k_mean(values, 0.4).alias("two"), S.bottom_k_mean(values, 0.01).alias("at_least_one"),
        S.bottom_k_mean(F.array().cast("array<double>"), 0.4).alias("none"),
    ).first()
    assert tuple(row) == (3.5, 4.0, 0.0)


def test_min_k_plus_plus_floors_the_variance(spark):
    tokens = [(-100, None, 1, None, None), (5, -1.0, 5, -2.0, 0.0), (2, -1.0, 2, 0.0, 1.0)]
    assert one(spark, tokens, S.min_k_plus_plus("tokens", 0.4)) == pytest.approx(-1.0 / math.sqrt(1e-6))


def test_vocab_moments(spark):
    probs = [0.5, 0.25, 0.25]
    row = spark.range(1).select(S.vocab_moments(F.array(*[F.lit(math.log(p)) for p in probs])).alias("m")).first()["m"]
    mu = sum(p * math.log(p) for p in probs)
    assert row["mu"] == pytest.approx(mu)
    assert row["sigma2"] == pytest.approx(sum(p * math.log(p) ** 2 for p in probs) - mu * mu)


def test_softmax(spark):
    row = spark.range(1).select(
        S.softmax_at(F.array(F.lit(2.0), F.lit(2.0))).alias("even"), S.softmax_at(F.array(F.lit(1000.0), F.lit(0.0))).alias("big")
    ).first()
    assert tuple(row) == (0.5, 1.0)


def test_two_level_mean(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, 1.0), (2, 0, None)], "index int, answer_idx int, v double")
    assert A.two_level_mean(df, "v").first()["agg_value"] == 0.75
    uneven = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0)], "index int, answer_idx int, v double")
    assert A.two_level_mean(uneven, "v").first()["agg_value"] == 0.5


def attack(spark, forget, holdout):
    rows = [("forget", s) for s in forget] + [("holdout", s) for s in holdout]
    return spark.createDataFrame(rows, "population string, score double")


def brute_auc(forget, holdout):
    wins = sum((f < h) + 0.5 * (f == h) for f in forget for h in holdout)
    return wins / (len(forget) * len(holdout))


def test_auc_with_ties_and_swapped_populations(spark):
    forget = [(i * 7 % 23) / 4 for i in range(120)]
    holdout = [(i * 5 % 29) / 4 for i in range(80)]
    auc = A.roc_auc(attack(spark, forget, holdout)).first()["auc"]
    assert auc == pytest.approx(brute_auc(forget, holdout))
    assert A.roc_auc(attack(spark, holdout, forget)).first()["auc"] == pytest.approx(1 - auc)
    assert A.roc_auc(attack(spark, [1.0] * 9, [1.0] * 4)).first()["auc"] == 0.5


def test_auc_of_an_empty_population_is_null(spark):
    assert A.roc_auc(attack(spark, [1.0, 2.0], [])).first()["auc"] is None


def test_ks_statistic_is_exact_and_symmetric(spark):
    a = [(i * 7 % 23) / 4 for i in range(60)]
    b = [(i * 5 % 29) / 4 for i in range(45)]
    def run(x, y):
        rows = [("target", s) for s in x] + [("retain", s) for s in y]
        return A.ks_test(spark.createDataFrame(rows, "run string, score double")).first()
    def cdf(v, t):
        return sum(s <= t for s in v) / len(v)
    want = max(abs(cdf(a, t) - cdf(b, t)) for t in a + b)
    one_way, other_way = run(a, b), run(b, a)
    assert one_way["statistic"] == pytest.approx(want) == other_way["statistic"]
    assert one_way["p_value"] == pytest.approx(other_way["p_value"])


def test_alignment_is_checked(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.5)], "index int, prob double")
    right = spark.createDataFrame([(1, 0.1), (3, 0.1)], "index int, prob double")
    with pytest.raises(A.AlignmentError):
        A.align(left, right, ["index"])
    answers = left.withColumn("answer_idx", F.lit(0)).union(right.withColumn("answer_idx", F.lit(1)))
    with pytest.raises(Exception, match="result sets differ, e.g. at index="):
        A.prob_with_options(answers).collect()
    assert A.prob_with_options(answers.where("index = 1")).count() == 1
    assert {(r["index"], r["only_in"]) for r in A.unmatched_keys(left, right, ["index"]).collect()} == {(2, "left"), (3, "right")}


def test_truth_ratio_averages_losses_before_the_exponential(spark):
    answers = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 3.0)], "index int, answer_idx int, avg_loss double")
    ratio = A.truth_ratio_scores(answers)
    assert ratio.first()["score"] == pytest.approx(math.exp(-2) / (math.exp(-1) + 1e-10))
    with pytest.raises(ValueError):
        A.truth_ratio_agg(ratio, "other")


def test_nan_ratio_stays_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (0.5,)], "score double")
    for name in S.TRUTH_RATIO_AGGREGATORS:
        assert math.isnan(A.truth_ratio_agg(df, name).first()["agg_value"])


def test_derived_values(spark):
    row = spark.range(1).select(
        A.privleak(F.lit(0.9), F.lit(0.5)).alias("p"), A.privleak(F.lit(0.9), F.lit(None).cast("double")).alias("q"),
        A.rel_diff(F.lit(0.9), F.lit(0.6)).alias("r"),
    ).first()
    assert row["p"] == pytest.approx(-80, abs=1e-6) and row["q"] == pytest.approx(-80, abs=1e-6) and row["r"] == pytest.approx(50, abs=1e-6)


def test_harmonic_mean(spark):
    def hm(values):
        return A.harmonic_mean(spark.createDataFrame([(v,) for v in values], "agg_value double")).first()["agg_value"]
    assert hm([1.0, 0.5]) == pytest.approx(2 / 3)
    assert hm([1.0, 0.0]) == 0.0
    for bad in ([1.0, -1.0], [1.0, None]):
        with pytest.raises(Exception, match="harmonic mean"):
            hm(bad)


def test_token_rows_and_packed_tokens_agree(spark):
    rows = []
    for index in range(40):
        for pos in range(index % 9):
            label = -100 if pos < 2 else pos
            rows.append((index, 0, pos, label, -float((index * 31 + pos * 17) % 97) / 32, label + (index + pos) % 2))
    df = spark.createDataFrame(rows, "index long, answer_idx int, pos int, label_id int, logprob double, pred_id int")
    keys = ["index", "answer_idx"]
    packed = A.pack_tokens(df, keys)
    loss = {r["index"]: r["v"] for r in packed.select("index", S.avg_loss("tokens").alias("v")).collect()}
    for r in A.losses_from_tokens(df, keys).collect():
        assert r["avg_loss"] == loss[r["index"]] or math.isnan(r["avg_loss"]) and math.isnan(loss[r["index"]])
    exact = {r["index"]: r["v"] for r in packed.select("index", S.exact_memorization("tokens").alias("v")).collect()}
    found = {r["index"]: r["score"] for r in A.memorization_from_tokens(df, keys).collect()}
    assert found == {k: v for k, v in exact.items() if v is not None}


def test_answers_are_listed_in_order(spark):
    df = spark.createDataFrame([(1, 2, 0.3), (1, 0, 0.1), (1, 1, 0.2)], "index int, answer_idx int, p double")
    assert A.transpose_answers(df, ["p"]).first()["p"] == [0.1, 0.2, 0.3]
    assert A.duplicate_indices(df.unionByName(df.limit(1))).count() == 1


def test_gradnorm_checks_the_norm(spark):
    df = spark.createDataFrame([("forget", 1, "w", 1.0, 2.0), ("forget", 1, "b", 3.0, 2.0)], "population string, index int, param string, norm double, p double")
    assert A.gradnorm_scores(df, p=2).first()["score"] == 2.0
    with pytest.raises(ValueError):
        A.gradnorm_scores(df, p=3)


def test_target_words_of_a_long_text(spark):
    """Labels taken from structs, one text of 100,000 words: linear, or it would not end."""
    words = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("words"))
    tokens = words.withColumn("tokens", F.transform("words", lambda w, i: F.struct(F.when(i % 3 == 0, -100).otherwise(i).alias("label_id"), w.alias("x"))))
    # a shuffle keeps the two steps from being folded into one
    kept = tokens.repartition(2, F.size("words")).select(target_words(F.col("words"), F.col("tokens.label_id")).alias("t")).first()["t"]
    assert kept == [f"w{i}" for i in range(100_000) if i % 3]


def test_target_words_skip_what_is_missing(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [1, -100, None])], "w array<string>, l array<int>")
    assert df.select(target_words(F.col("w"), F.col("l")).alias("t")).first()["t"] == ["a"]


def test_reference_scores_need_both_models(spark):
    own = spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0)], "index long, answer_idx int, avg_loss double")
    other = spark.createDataFrame([(1, 0, 1.5), (3, 0, 1.0)], "index long, answer_idx int, avg_loss double")
    assert [r["score"] for r in A.reference_scores(own.where("index = 1"), other.where("index = 1")).collect()] == [0.5]
    for a, b in ((own, other.where("index = 1")), (own.where("index = 1"), other)):
        with pytest.raises(Exception, match="without both models"):
            A.reference_scores(a, b).collect()
