"""Queries: per-example scores and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import scores as S
from lethe.operators import aggregates as A
from lethe.operators.similarity import text_similarity
from lethe.operators.tokens import target_text, zlib_score
from lethe.plans.catalog import query
from lethe.plans.inputs import (
    GENERATIONS_SQL,
    LABEL,
    LOGPROB,
    MU,
    POPULATION_SQL,
    PRED,
    SIGMA2,
    generations,
    scores_by_example,
    token_rows,
    token_scores,
    token_sql,
    with_population,
)
from lethe.session import scratch_path
from lethe.sources.logs import metric_values_from_json, reference_values

BOTH = {"target": 0, "retain": 5}
TOK = "tokens"
LOSS, MATCH, MOMENTS = (LABEL, LOGPROB), (LABEL, PRED), (LABEL, LOGPROB, MU, SIGMA2)


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# ------------------------------------------------------------ per-example scores

@query(
    "scr1_avg_loss_prob",
    f"""WITH {token_sql()}
SELECT index, round(avg_loss, 6) AS avg_loss, round(exp(-avg_loss), 6) AS prob FROM loss""",
)
def scr1(spark: SparkSession, sf: str) -> DataFrame:
    scored = token_scores(spark, sf, fields=LOSS).select("index", S.avg_loss(TOK).alias("avg_loss"))
    return scored.select("index", r6(F.col("avg_loss"), "avg_loss"), r6(S.prob_from_loss(F.col("avg_loss")), "prob"))


@query(
    "scr1_avg_loss_prob_token_rows",
    f"""WITH {token_sql(answers=2)}
SELECT index, answer_idx::INTEGER AS answer_idx, round(avg_loss, 6) AS avg_loss, round(exp(-avg_loss), 6) AS prob FROM loss""",
)
def scr1_rows(spark: SparkSession, sf: str) -> DataFrame:
    scored = scores_by_example(spark, sf, {"target": 0}, 2)
    return scored.select("index", "answer_idx", r6(F.col("avg_loss"), "avg_loss"), r6(F.col("prob"), "prob"))


@query(
    "scr2_exact_memorization_token_rows",
    f"""WITH {token_sql()}
SELECT index, round(sum(CASE WHEN pred_id = label_id THEN 1.0::DOUBLE ELSE 0 END) / count(*), 6) AS score
FROM scored GROUP BY index""",
)
def scr2_rows(spark: SparkSession, sf: str) -> DataFrame:
    scored = A.memorization_from_tokens(token_rows(spark, sf, fields=MATCH), ["index"])
    return scored.select("index", r6(F.col("score"), "score"))


@query(
    "scr2_exact_memorization",
    f"""WITH {token_sql()}
SELECT e.index, round(sum(CASE WHEN pred_id = label_id THEN 1.0::DOUBLE ELSE 0 END) / count(s.pos), 6) AS score
FROM ex e LEFT JOIN scored s USING (index) GROUP BY e.index HAVING count(s.pos) > 0
UNION ALL
SELECT e.index, NULL FROM ex e WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.index = e.index)""",
)
def scr2(spark: SparkSession, sf: str) -> DataFrame:
    return token_scores(spark, sf, fields=MATCH).select("index", r6(S.exact_memorization(TOK), "score"))


_EXTRACTION_SQL = """
strength AS (
  SELECT e.run, e.source, e.index,
         CASE WHEN count(s.pos) = 0 THEN 0.0::DOUBLE
              ELSE greatest(max(s.pos) - coalesce(max(CASE WHEN pred_id <> label_id THEN s.pos END), min(s.pos) - 1), 1)::DOUBLE
                   / count(s.pos) END AS score
  FROM ex e LEFT JOIN scored s USING (run, index) GROUP BY ALL)"""


@query(
    "scr3_extraction_strength",
    f"WITH {token_sql()}, {_EXTRACTION_SQL} SELECT index, round(score, 6) AS score FROM strength",
)
def scr3(spark: SparkSession, sf: str) -> DataFrame:
    return token_scores(spark, sf, fields=MATCH).select("index", r6(S.extraction_strength(TOK), "score"))


@query(
    "win3_longest_correct_suffix",
    f"""WITH {token_sql()}
SELECT e.index,
       (max(s.pos) - coalesce(max(CASE WHEN pred_id <> label_id THEN s.pos END), min(s.pos) - 1))::INTEGER AS suffix_len,
       count(s.pos)::INTEGER AS n_tokens
FROM ex e JOIN scored s USING (index) GROUP BY e.index
UNION ALL
SELECT e.index, 0::INTEGER, 0::INTEGER FROM ex e WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.index = e.index)""",
)
def win3(spark: SparkSession, sf: str) -> DataFrame:
    return token_scores(spark, sf, fields=MATCH).select(
        "index", S.correct_suffix_length(TOK).alias("suffix_len"), F.size(S.scored_tokens(TOK)).alias("n_tokens")
    )


@query(
    "flt7_labelled_tokens",
    f"""WITH {token_sql()}
SELECT e.index, count(s.pos)::INTEGER AS n_scored, coalesce(sum(s.label_id), 0)::BIGINT AS label_sum
FROM ex e LEFT JOIN scored s USING (index) GROUP BY e.index""",
)
def flt7(spark: SparkSession, sf: str) -> DataFrame:
    kept = token_scores(spark, sf, fields=MATCH).select("index", S.scored_tokens(TOK).alias("k"))
    return kept.select(
        "index",
        F.size("k").alias("n_scored"),
        F.aggregate(F.col("k.label_id"), F.lit(0).cast("long"), lambda a, v: a + v).alias("label_sum"),
    )


@query(
    "scr7_loss_attack",
    f"""WITH {token_sql()}, {POPULATION_SQL}
SELECT population, index, round(avg_loss, 6) AS score FROM loss JOIN pop USING (index)""",
)
def scr7(spark: SparkSession, sf: str) -> DataFrame:
    scored = token_scores(spark, sf, fields=LOSS).select("index", r6(S.avg_loss(TOK), "score"))
    return with_population(spark, sf, scored).select("population", "index", "score")


def _bottom_k_sql(value: str, k: float, name: str = "mink") -> str:
    return f"""
{name} AS (
  SELECT e.index, coalesce(-avg(CASE WHEN rn <= greatest(1, trunc(n * {k}::DOUBLE)) THEN v END), 0.0) AS score
  FROM ex e LEFT JOIN (
    SELECT index, {value} AS v, row_number() OVER (PARTITION BY index ORDER BY {value}) AS rn,
           count(*) OVER (PARTITION BY index) AS n
    FROM scored) s USING (index)
  GROUP BY e.index)"""


_MINK_PP = "(logprob - mu) / sqrt(greatest(sigma2, 1e-6::DOUBLE))"


@query("scr8_min_k", f"WITH {token_sql()}, {_bottom_k_sql('logprob', 0.4)} SELECT index, round(score, 6) AS score FROM mink")
def scr8(spark: SparkSession, sf: str) -> DataFrame:
    return token_scores(spark, sf, fields=LOSS).select("index", r6(S.min_k(TOK, 0.4), "score"))


@query("win2_bottom_k_mean", f"WITH {token_sql()}, {_bottom_k_sql('logprob', 0.2)} SELECT index, round(score, 6) AS score FROM mink")
def win2(spark: SparkSession, sf: str) -> DataFrame:
    values = F.transform(S.scored_tokens(TOK), lambda t: t["logprob"])
    return token_scores(spark, sf, fields=LOSS).select("index", r6(S.bottom_k_mean(values, 0.2), "score"))


@query("scr9_min_k_plus_plus", f"WITH {token_sql()}, {_bottom_k_sql(_MINK_PP, 0.4)} SELECT index, round(score, 5) AS score FROM mink")
def scr9(spark: SparkSession, sf: str) -> DataFrame:
    return token_scores(spark, sf, fields=MOMENTS).select("index", F.round(S.min_k_plus_plus(TOK, 0.4), 5).alias("score"))


@query("scr10_zlib_score")
def scr10(spark: SparkSession, sf: str) -> DataFrame:
    return token_scores(spark, sf, fields=LOSS).select(
        "index", r6(zlib_score(S.avg_loss(TOK), target_text(F.col("words"), F.col("tokens.label_id"))), "score")
    )


@query(
    "scr11_reference_score",
    f"""WITH {token_sql(BOTH)}
SELECT t.index, round(t.avg_loss - r.avg_loss, 6) AS score
FROM loss t JOIN loss r ON t.index = r.index AND t.answer_idx = r.answer_idx AND r.run = 'retain'
WHERE t.run = 'target'""",
)
def scr11(spark: SparkSession, sf: str) -> DataFrame:
    target = scores_by_example(spark, sf, {"target": 0}, 1)
    retain = scores_by_example(spark, sf, {"retain": 5}, 1)
    return A.reference_scores(target, retain).select("index", r6(F.col("score"), "score"))


@query(
    "jn5_join_reference_model",
    f"""WITH {token_sql(BOTH, 2)}
SELECT t.index, t.answer_idx::INTEGER AS answer_idx, round(t.avg_loss, 6) AS target_loss, round(r.avg_loss, 6) AS reference_loss
FROM loss t JOIN loss r ON t.index = r.index AND t.answer_idx = r.answer_idx AND r.run = 'retain'
WHERE t.run = 'target'""",
)
def jn5(spark: SparkSession, sf: str) -> DataFrame:
    target = scores_by_example(spark, sf, {"target": 0}, 2)
    retain = scores_by_example(spark, sf, {"retain": 5}, 2)
    joined = A.reference_scores(target, retain)
    return joined.select(
        "index", "answer_idx", r6(F.col("avg_loss"), "target_loss"),
        r6(F.col("avg_loss") - F.col("score"), "reference_loss"),
    )


@query(
    "scr12_gradnorm_score",
    f"""WITH {POPULATION_SQL},
norms AS (
  SELECT l_orderkey, l_partkey, sqrt(sum(l_quantity * l_quantity)) AS norm FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS index, round(avg(norm), 6) AS score FROM norms GROUP BY ALL""",
)
def scr12(spark: SparkSession, sf: str) -> DataFrame:
    """An order is an example, a part a parameter, its 2-norm over quantities the gradient norm."""
    norms = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("index"), F.col("l_partkey").alias("param"))
        .agg(F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity"))).alias("norm"))
        .withColumn("p", F.lit(2.0))
    )
    return A.gradnorm_scores(norms, ["index"], p=2).select("index", r6(F.col("score"), "score"))


@query(
    "scr13_classifier_score",
    """SELECT doc_id AS index, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS score
FROM (SELECT doc_id, a, b, c, greatest(a, b, c) AS m FROM (
  SELECT doc_id, (length(text) % 7)::DOUBLE / 4 AS a, (doc_id % 5)::DOUBLE / 4 AS b, (n_chars % 11)::DOUBLE / 4 AS c
  FROM documents))""",
)
def scr13(spark: SparkSession, sf: str) -> DataFrame:
    logits = F.array(
        *[(c % m).cast("double") / 4 for c, m in ((F.length("text"), 7), (F.col("doc_id"), 5), (F.col("n_chars"), 11))]
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").alias("index"), r6(S.softmax_at(logits, 0), "score"))


_OPTIONS_SQL = """
c AS (SELECT index, avg(exp(-avg_loss)) AS p FROM loss WHERE answer_idx = 0 GROUP BY index),
x AS (SELECT index, sum(exp(-avg_loss)) AS p FROM loss WHERE answer_idx > 0 GROUP BY index)"""


@query(
    "scr14_prob_w_options",
    f"""WITH {token_sql(answers=5)}, {_OPTIONS_SQL}
SELECT c.index, round(c.p / (c.p + x.p + 1e-10::DOUBLE), 6) AS prob FROM c JOIN x USING (index)""",
)
def scr14(spark: SparkSession, sf: str) -> DataFrame:
    answers = scores_by_example(spark, sf, {"target": 0}, 5)
    return A.prob_with_options(answers).select("index", r6(F.col("prob"), "prob"))


_RATIO_SQL = """
ratio AS (
  SELECT run, source, index,
         exp(-avg(CASE WHEN answer_idx > 0 THEN avg_loss END))
           / (exp(-avg(CASE WHEN answer_idx = 0 THEN avg_loss END)) + 1e-10::DOUBLE) AS score
  FROM loss GROUP BY ALL)"""


def truth_ratios(spark: SparkSession, sf: str, salts: dict[str, int]) -> DataFrame:
    """Truth ratio per (run, source, index), rounded so that equal ratios tie on every platform."""
    ratios = A.truth_ratio_scores(scores_by_example(spark, sf, salts, 5), ["run", "source", "index"])
    return ratios.withColumn("score", F.round("score", 6))


@query("scr15_truth_ratio_score", f"WITH {token_sql(answers=5)}, {_RATIO_SQL} SELECT index, round(score, 6) AS score FROM ratio")
def scr15(spark: SparkSession, sf: str) -> DataFrame:
    return truth_ratios(spark, sf, {"target": 0}).select("index", "score")


@query(
    "jn3_align_correct_wrong",
    f"""WITH {token_sql(answers=5)}
SELECT index, count(*) FILTER (answer_idx = 0) AS n_correct, count(*) FILTER (answer_idx > 0) AS n_wrong
FROM loss GROUP BY index HAVING n_correct > 0 AND n_wrong > 0""",
)
def jn3(spark: SparkSession, sf: str) -> DataFrame:
    answers = scores_by_example(spark, sf, {"target": 0}, 5)
    return A.align(
        answers.where("answer_idx = 0").groupBy("index").agg(F.count("*").alias("n_correct")),
        answers.where("answer_idx > 0").groupBy("index").agg(F.count("*").alias("n_wrong")),
        ["index"],
    )


# ------------------------------------------------------------ text similarity

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "scr4_rouge1_recall",
    f"""WITH {GENERATIONS_SQL},
ref AS (SELECT index, w, count(*) AS n FROM (SELECT index, unnest(string_split({_NORM.format('ground_truth')}, ' ')) AS w FROM gen) WHERE w <> '' GROUP BY ALL),
hyp AS (SELECT index, w, count(*) AS n FROM (SELECT index, unnest(string_split({_NORM.format('generation')}, ' ')) AS w FROM gen) WHERE w <> '' GROUP BY ALL),
hits AS (SELECT ref.index, sum(least(ref.n, coalesce(hyp.n, 0)))::DOUBLE / sum(ref.n) AS r FROM ref LEFT JOIN hyp ON ref.index = hyp.index AND ref.w = hyp.w GROUP BY ALL)
SELECT gen.index, round(coalesce(hits.r, 0.0), 6) AS rouge1_recall FROM gen LEFT JOIN hits USING (index)""",
)
def scr4(spark: SparkSession, sf: str) -> DataFrame:
    scored = text_similarity(generations(spark, sf), use_stemmer=False)
    return scored.select("index", r6(F.col("rouge1_recall"), "rouge1_recall"))


_LCS_SQL = f"""WITH RECURSIVE {GENERATIONS_SQL},
words AS (
  SELECT index,
         list_filter(string_split({_NORM.format('ground_truth')}, ' '), lambda w: w <> '') AS ref,
         list_filter(string_split({_NORM.format('generation')}, ' '), lambda w: w <> '') AS hyp
  FROM gen),
step(index, i, val) AS (
  SELECT index, 0, list_transform(range(len(hyp) + 1), lambda z: 0) FROM words
  UNION ALL
  SELECT w.index, s.i + 1,
         list_reduce(range(1, len(w.hyp) + 1),
           lambda acc, j: list_append(acc,
             CASE WHEN w.hyp[j] = w.ref[s.i + 1] THEN s.val[j] + 1
                  ELSE greatest(s.val[j + 1], acc[j]) END), [0])
  FROM step s JOIN words w USING (index) WHERE s.i < len(w.ref)),
lcs AS (
  SELECT w.index, len(ref) AS n_ref, len(hyp) AS n_hyp, s.val[len(hyp) + 1] AS l
  FROM words w JOIN step s ON s.index = w.index AND s.i = len(w.ref))
SELECT index,
       round(CASE WHEN n_ref = 0 OR n_hyp = 0 THEN 0.0::DOUBLE ELSE l::DOUBLE / n_ref END, 6) AS "rougeL_recall",
       round(CASE WHEN n_ref = 0 OR n_hyp = 0 OR l = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * l / (n_ref + n_hyp) END, 6) AS "rougeL_f1"
FROM lcs"""


@query("scr5_rouge_l", _LCS_SQL)
def scr5(spark: SparkSession, sf: str) -> DataFrame:
    g = generations(spark, sf)
    return text_similarity(g, use_stemmer=False).select(
        "index", r6(F.col("rougeL_recall"), "rougeL_recall"), r6(F.col("rougeL_f1"), "rougeL_f1")
    )


@query("scr5_rouge_l_stemmed")
def scr5_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return text_similarity(generations(spark, sf)).select(
        "index",
        r6(F.col("rouge1_recall"), "rouge1_recall"),
        r6(F.col("rougeL_recall"), "rougeL_recall"),
        r6(F.col("rougeL_f1"), "rougeL_f1"),
    )


@query(
    "scr6_text_similarity_record",
    _LCS_SQL.replace("SELECT index,\n       round(", "SELECT index, gen.input, gen.ground_truth, gen.generation,\n       round(") + " JOIN gen USING (index)",
)
def scr6(spark: SparkSession, sf: str) -> DataFrame:
    """A record holds the texts beside their scores."""
    return text_similarity(generations(spark, sf), use_stemmer=False).select(
        "index", "input", "ground_truth", "generation", r6(F.col("rougeL_recall"), "rougeL_recall"), r6(F.col("rougeL_f1"), "rougeL_f1")
    )


@query(
    "jn10_attach_generation_classifier",
    f"""WITH {GENERATIONS_SQL}
SELECT index, generation, round(1.0::DOUBLE / (1.0::DOUBLE + exp(((index % 5) - (length(generation) % 7))::DOUBLE / 4)), 6) AS score FROM gen""",
)
def jn10(spark: SparkSession, sf: str) -> DataFrame:
    from lethe.operators.similarity import attach_classifier_scores

    g = generations(spark, sf)
    logits = g.select(
        "index",
        F.array((F.length("generation") % 7).cast("double") / 4, (F.col("index") % 5).cast("double") / 4).alias("logits"),
    )
    return attach_classifier_scores(g, logits, class_id=0).select("index", "generation", r6(F.col("score"), "score"))


# ------------------------------------------------------------ aggregates

_FLAT = f"WITH {token_sql(answers=5)}"


@query(
    "agg1_answers_to_1d",
    f"""{_FLAT}, per AS (SELECT source, index, avg(exp(-avg_loss)) AS p FROM loss GROUP BY ALL)
SELECT source, round(avg(p), 6) AS agg_value FROM per GROUP BY source""",
)
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    probs = scores_by_example(spark, sf, {"target": 0}, 5)
    return A.two_level_mean(probs, "prob", group=["source"]).select("source", r6(F.col("agg_value"), "agg_value"))


@query(
    "agg2_transpose_answers",
    f"""{_FLAT}
SELECT index, string_agg(round(avg_loss * 32, 0)::BIGINT::VARCHAR, ',' ORDER BY answer_idx) AS losses FROM loss GROUP BY index""",
)
def agg2(spark: SparkSession, sf: str) -> DataFrame:
    df = scores_by_example(spark, sf, {"target": 0}, 5)
    listed = A.transpose_answers(df, ["avg_loss"])
    return listed.select(
        "index",
        F.array_join(
            F.transform("avg_loss", lambda v: F.round(v * 32, 0).cast("long").cast("string")), ","
        ).alias("losses"),
    )


@query("agg3_metric_mean", f"WITH RECURSIVE scored_l AS ({_LCS_SQL}) SELECT round(avg(\"rougeL_f1\"), 5) AS agg_value FROM scored_l")
def agg3(spark: SparkSession, sf: str) -> DataFrame:
    scores = text_similarity(generations(spark, sf), use_stemmer=False).select("index", r6(F.col("rougeL_f1"), "rougeL_f1"))
    return A.two_level_mean(scores, "rougeL_f1").select(F.round("agg_value", 5).alias("agg_value"))


@query(
    "agg4_truth_ratio_closer_to_1",
    f"""{_FLAT}, {_RATIO_SQL}, r AS (SELECT source, round(score, 6) AS score FROM ratio)
SELECT source, round(avg(least(score, 1.0::DOUBLE / (score + 1e-10::DOUBLE))), 6) AS agg_value FROM r GROUP BY source""",
)
def agg4(spark: SparkSession, sf: str) -> DataFrame:
    ratios = truth_ratios(spark, sf, {"target": 0})
    return A.truth_ratio_agg(ratios, "closer_to_1_better", ["source"]).select("source", r6(F.col("agg_value"), "agg_value"))


@query(
    "agg5_truth_ratio_true_better",
    f"""{_FLAT}, {_RATIO_SQL}, r AS (SELECT source, round(score, 6) AS score FROM ratio)
SELECT source, round(avg(greatest(0.0::DOUBLE, 1.0::DOUBLE - score)), 6) AS agg_value FROM r GROUP BY source""",
)
def agg5(spark: SparkSession, sf: str) -> DataFrame:
    ratios = truth_ratios(spark, sf, {"target": 0})
    return A.truth_ratio_agg(ratios, "true_better", ["source"]).select("source", r6(F.col("agg_value"), "agg_value"))


def loss_attack(spark: SparkSession, sf: str) -> DataFrame:
    losses = scores_by_example(spark, sf, {"target": 0}, 1)
    scored = losses.select("source", "index", F.round("avg_loss", 6).alias("score"))
    return with_population(spark, sf, scored)


_ATTACK_SQL = f"""WITH {token_sql()}, {POPULATION_SQL},
att AS (SELECT source, population, index, round(avg_loss, 6) AS score FROM loss JOIN pop USING (index))"""


@query(
    "agg6_attack_summary",
    f"""{_ATTACK_SQL}
SELECT population, round(avg(score), 6) AS agg_value, count(*) AS n_examples FROM att GROUP BY population""",
)
def agg6(spark: SparkSession, sf: str) -> DataFrame:
    return A.attack_summary(loss_attack(spark, sf)).select("population", r6(F.col("agg_value"), "agg_value"), "n_examples")


_AUC_TAIL = """
SELECT {g} round(sum(CASE WHEN f.score < h.score THEN 1.0::DOUBLE WHEN f.score = h.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 6) AS auc
FROM att f JOIN att h ON f.population = 'forget' AND h.population = 'holdout' {on} {tail}"""


@query("agg7_mia_auc_loss", _ATTACK_SQL + _AUC_TAIL.format(g="", on="", tail=""))
def agg7(spark: SparkSession, sf: str) -> DataFrame:
    return A.roc_auc(loss_attack(spark, sf)).select(r6(F.col("auc"), "auc"))


@query(
    "agg7_mia_auc_loss_by_source",
    _ATTACK_SQL + _AUC_TAIL.format(g="f.source,", on="AND f.source = h.source", tail="GROUP BY f.source"),
)
def agg7_by_source(spark: SparkSession, sf: str) -> DataFrame:
    auc = A.roc_auc(loss_attack(spark, sf), ["source"])
    return auc.where(F.col("auc").isNotNull()).select("source", r6(F.col("auc"), "auc"))


def _token_attack_sql(value: str, digits: int) -> str:
    return f"""WITH {token_sql()}, {POPULATION_SQL}, {_bottom_k_sql(value, 0.4)},
att AS (SELECT population, index, round(score, {digits}) AS score FROM mink JOIN pop USING (index))"""


@query("agg7_mia_auc_min_k", _token_attack_sql("logprob", 6) + _AUC_TAIL.format(g="", on="", tail=""))
def agg7_min_k(spark: SparkSession, sf: str) -> DataFrame:
    scored = token_scores(spark, sf, fields=LOSS).select("index", r6(S.min_k(TOK, 0.4), "score"))
    return A.roc_auc(with_population(spark, sf, scored)).select(r6(F.col("auc"), "auc"))


@query("agg7_mia_auc_min_k_plus_plus", _token_attack_sql(_MINK_PP, 4) + _AUC_TAIL.format(g="", on="", tail=""))
def agg7_min_k_pp(spark: SparkSession, sf: str) -> DataFrame:
    scored = token_scores(spark, sf, fields=MOMENTS).select("index", F.round(S.min_k_plus_plus(TOK, 0.4), 4).alias("score"))
    return A.roc_auc(with_population(spark, sf, scored)).select(r6(F.col("auc"), "auc"))


@query(
    "agg7_mia_auc_reference",
    f"""WITH {token_sql(BOTH)}, {POPULATION_SQL},
att AS (SELECT population, t.index, round(t.avg_loss - r.avg_loss, 6) AS score
  FROM loss t JOIN loss r ON t.index = r.index AND r.run = 'retain' JOIN pop ON pop.index = t.index WHERE t.run = 'target')"""
    + _AUC_TAIL.format(g="", on="", tail=""),
)
def agg7_reference(spark: SparkSession, sf: str) -> DataFrame:
    target = scores_by_example(spark, sf, {"target": 0}, 1)
    retain = scores_by_example(spark, sf, {"retain": 5}, 1)
    scored = A.reference_scores(target, retain).select("index", r6(F.col("score"), "score"))
    return A.roc_auc(with_population(spark, sf, scored)).select(r6(F.col("auc"), "auc"))


@query("agg7_mia_auc_zlib")
def agg7_zlib(spark: SparkSession, sf: str) -> DataFrame:
    scored = token_scores(spark, sf, fields=LOSS).select(
        "index", zlib_score(S.avg_loss(TOK), target_text(F.col("words"), F.col("tokens.label_id"))).alias("score")
    )
    return A.roc_auc(with_population(spark, sf, scored)).select(r6(F.col("auc"), "auc"))


@query(
    "agg7_mia_auc_gradnorm",
    """WITH norms AS (
  SELECT l_orderkey, l_partkey, sqrt(sum(l_quantity * l_quantity)) AS norm FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, round(avg(norm), 4) AS score FROM norms GROUP BY ALL),
a AS (SELECT score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS m FROM s JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT m, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM a)
SELECT round((sum(CASE WHEN m = 0 THEN rk ELSE 0 END) - count(*) FILTER (m = 0) * (count(*) FILTER (m = 0) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (m = 0)::DOUBLE * count(*) FILTER (m = 1)), 6) AS auc FROM k""",
)
def agg7_gradnorm(spark: SparkSession, sf: str) -> DataFrame:
    norms = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("index"), F.col("l_partkey").alias("param"))
        .agg(F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity"))).alias("norm"))
        .withColumn("p", F.lit(2.0))
    )
    scored = A.gradnorm_scores(norms, ["index"], p=2).withColumn("score", F.round("score", 4))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("index"),
        F.when(F.col("o_orderstatus") == "F", "forget").otherwise("holdout").alias("population"),
    )
    return A.roc_auc(scored.join(orders, "index")).select(r6(F.col("auc"), "auc"))


_KS_SQL = f"""WITH {token_sql(BOTH, 5)}, {_RATIO_SQL},
s AS (SELECT source, run, {{score}} AS score FROM ratio),
n AS (SELECT source, count(*) FILTER (run = 'target') AS n1, count(*) FILTER (run = 'retain') AS n2 FROM s GROUP BY source),
c AS (SELECT DISTINCT source, score,
        sum(CASE WHEN run = 'target' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY score) AS c1,
        sum(CASE WHEN run = 'retain' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY score) AS c2 FROM s)
SELECT source, n1, n2, round(max(abs(c1::DOUBLE / n1 - c2::DOUBLE / n2)), 6) AS statistic
FROM c JOIN n USING (source) GROUP BY source, n1, n2"""


@query("agg8_ks_statistic", _KS_SQL.format(score="round(score, 6)"))
def agg8(spark: SparkSession, sf: str) -> DataFrame:
    found = A.ks_statistic(truth_ratios(spark, sf, BOTH), ["source"])
    return found.select("source", "n1", "n2", r6(F.col("statistic"), "statistic"))


def _ks_series_sql(score: str) -> str:
    """Both samples hold the same documents, so the equal-size series applies."""
    stat = _KS_SQL.format(score=score).replace("SELECT source, n1, n2, round(", "SELECT source, n1, n2, max(abs(c1 - c2))::BIGINT AS h, round(")
    return f"""WITH stat AS ({stat}),
term AS (
  SELECT source, n1, k, CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
    * (SELECT product((n1 - k * h + i)::DOUBLE / (n1 + i)) FROM range(1, k * h + 1) r(i)) AS t
  FROM stat, range(1, 100000) s(k) WHERE h > 0 AND k <= n1 // h),
p AS (SELECT source, round(least(1.0::DOUBLE, coalesce(2 * sum(t), 1.0::DOUBLE)), 9) AS p_value FROM stat LEFT JOIN term USING (source) GROUP BY source)
"""


_KS_SERIES_SQL = _ks_series_sql("round(score, 6)")


@query("agg8_forget_quality", _KS_SERIES_SQL + "SELECT source, stat.n1, stat.n2, statistic, p_value FROM stat JOIN p USING (source)")
def forget_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Token scores -> losses -> truth ratios of two runs -> KS test, per source."""
    found = A.ks_test(truth_ratios(spark, sf, BOTH), ["source"])
    return found.select("source", "n1", "n2", r6(F.col("statistic"), "statistic"), F.round("p_value", 9).alias("p_value"))


@query("agg8_ks_test", _KS_SERIES_SQL + "SELECT source, p_value FROM p")
def ks_test(spark: SparkSession, sf: str) -> DataFrame:
    found = A.ks_test(truth_ratios(spark, sf, BOTH), ["source"])
    return found.select("source", F.round("p_value", 9).alias("p_value"))


INDICES_PER_FILE = 10_000

_REFERENCE_SQL = _KS_SERIES_SQL.replace(
    "s AS (SELECT source, run,", "s AS (SELECT 'all' AS source, run,"
)


def write_reference(scores: DataFrame, folder: str, indices: int = INDICES_PER_FILE) -> None:
    """Evaluation files of a run: an object and a file of their own for every `indices` numbers."""
    entry = F.struct(F.col("index").cast("string"), F.struct("score"))
    bodies = scores.groupBy(F.floor(F.col("index") / indices)).agg(F.map_from_entries(F.collect_list(entry)).alias("value_by_index"))
    lines = bodies.select(F.to_json(F.create_map(F.lit("forget_truth_ratio"), F.struct("value_by_index"))))
    lines.write.option("maxRecordsPerFile", 1).text(folder)


@query("src6_reference_values", _REFERENCE_SQL + "SELECT stat.n1, stat.n2, statistic, p_value FROM stat JOIN p USING (source)")
def reference_values_ks(spark: SparkSession, sf: str) -> DataFrame:
    """A retain run stored as an evaluation file is read back and tested against."""
    ratios = truth_ratios(spark, sf, BOTH)
    root = scratch_path(spark, "reference")
    write_reference(ratios.where("run = 'retain'"), f"{root}/retain")
    values = metric_values_from_json(spark, root, "part-*")
    reference = reference_values(values, "retain", "forget_truth_ratio")
    both = ratios.where("run = 'target'").select(F.lit("target").alias("run"), "score").union(reference.select(F.lit("retain").alias("run"), "score"))
    found = A.ks_test(both)
    return found.select("n1", "n2", r6(F.col("statistic"), "statistic"), F.round("p_value", 9).alias("p_value"))


@query(
    "agg9_ks_reciprocal",
    _ks_series_sql("1.0::DOUBLE / (round(score, 6) + 1e-10::DOUBLE)") + "SELECT source, stat.n1, stat.n2, statistic, p_value FROM stat JOIN p USING (source)",
)
def agg9(spark: SparkSession, sf: str) -> DataFrame:
    found = A.ks_test_reciprocal(truth_ratios(spark, sf, BOTH), ["source"])
    return found.select("source", "n1", "n2", r6(F.col("statistic"), "statistic"), F.round("p_value", 9).alias("p_value"))


@query(
    "set1_union_populations",
    """SELECT CASE WHEN l.quality = 1 THEN 'forget' ELSE 'holdout' END AS population,
  CASE WHEN l.quality = 1 THEN 0 ELSE 1 END::INTEGER AS label, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""",
)
def set1(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("index"))
    pop = with_population(spark, sf, docs)
    both = A.union_populations(
        pop.where("population = 'forget'").drop("population"), pop.where("population = 'holdout'").drop("population")
    )
    return both.groupBy("population", "label").agg(F.count("*").alias("n"))


@query(
    "set3_duplicate_index_check",
    "SELECT p_name, p_brand, count(*) AS n_rows FROM part GROUP BY ALL HAVING count(*) > 1",
)
def set3(spark: SparkSession, sf: str) -> DataFrame:
    return A.duplicate_indices(spark.read.parquet(f"{sf}/part.parquet"), ["p_name", "p_brand"])


@query(
    "flt6_drop_unscored",
    f"""WITH {token_sql()}, e AS (
  SELECT index, sum(CASE WHEN pred_id = label_id THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS v FROM scored GROUP BY index)
SELECT count(*) AS n_scored, round(avg(v), 6) AS agg_value FROM e""",
)
def flt6(spark: SparkSession, sf: str) -> DataFrame:
    em = token_scores(spark, sf, fields=MATCH).select("index", S.exact_memorization(TOK).alias("v"))
    return em.agg(F.count("v").alias("n_scored"), r6(F.avg("v"), "agg_value"))
