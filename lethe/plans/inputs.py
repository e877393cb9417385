"""Stand-ins for model outputs, derived from whole driver tables.

A model run is not available, so its outputs are integer functions of the
tables' keys and words; the SQL side of every query states the same rule.
Log-probabilities are multiples of 1/32 and moments multiples of 1/16 and 1/8:
their sums are exact in binary, whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROMPT_WORDS = 8
WORD_SPLIT = r"[ \n\t]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a stand-in for model outputs out by key: real outputs come as many
    files, the driver's tables as one.  No job runs and nothing is asked for."""
    return df.repartition(key)


# ---------------------------------------------------------------- tokens

LABEL, LOGPROB, PRED, MU, SIGMA2 = "label_id", "logprob", "pred_id", "mu", "sigma2"


def _token_fields(doc_id: Column, n: Column, word: Column, pos: Column, salt: Column, answer: Column) -> dict[str, Column]:
    length = F.length(word)
    labelled = pos >= F.least(F.lit(PROMPT_WORDS), n - 1)
    return {
        LABEL: F.when(labelled, length).otherwise(F.lit(-100)),
        LOGPROB: -(((doc_id * 31 + pos * 17 + salt + answer * 7) % 97) + 1).cast("double") / F.lit(32.0),
        PRED: length + ((doc_id + pos + salt) % 3 == 0).cast("int"),
        MU: -(((doc_id + pos * 5 + salt) % 31) + 1).cast("double") / F.lit(16.0),
        SIGMA2: ((doc_id * 3 + pos + salt) % 13).cast("double") / F.lit(8.0),
    }


def _examples(spark: SparkSession, sf_dir: str, salts: dict[str, int] | None, answers: int) -> DataFrame:
    salts = salts or {"target": 0}
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "source", "text")
    docs = spread(docs, "index").select("index", "source", F.split("text", WORD_SPLIT).alias("words"))
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(s).alias("salt")) for r, s in salts.items()])
    ids = F.array(*[F.lit(a) for a in range(answers)])
    if len(salts) == 1 and answers == 1:
        (run, salt), = salts.items()
        return docs.select("*", F.lit(run).alias("run"), F.lit(salt).alias("salt"), F.lit(0).alias("answer_idx"))
    each = docs.select("*", F.explode(runs).alias("r")).select("*", F.explode(ids).alias("answer_idx"))
    return each.select("index", "source", "words", "r.run", "r.salt", "answer_idx")


def token_scores(
    spark: SparkSession,
    sf_dir: str,
    salts: dict[str, int] | None = None,
    answers: int = 1,
    fields: tuple[str, ...] = (LABEL, LOGPROB, PRED),
) -> DataFrame:
    """One row per example with a token array: every document, whole text."""
    index, n, salt, answer = F.col("index"), F.size("words"), F.col("salt"), F.col("answer_idx")

    def token(word: Column, pos: Column) -> Column:
        made = _token_fields(index, n, word, pos, salt, answer)
        return F.struct(*[made[f].alias(f) for f in fields])

    return _examples(spark, sf_dir, salts, answers).select(
        "run", "source", "index", "answer_idx", "words", F.transform("words", token).alias("tokens")
    )


def token_rows(
    spark: SparkSession,
    sf_dir: str,
    salts: dict[str, int] | None = None,
    answers: int = 1,
    fields: tuple[str, ...] = (LABEL, LOGPROB),
) -> DataFrame:
    """One row per token, for the aggregates that read model output as it is written."""
    words = _examples(spark, sf_dir, salts, answers).select(
        "run", "salt", "source", "index", "answer_idx", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word")
    ).where(F.col("word").isNotNull())
    made = _token_fields(*[F.col(c) for c in ("index", "n", "word", "pos", "salt", "answer_idx")])
    return words.select("run", "source", "index", "answer_idx", "pos", *[made[f].alias(f) for f in fields])


def token_sql(salts: dict[str, int] | None = None, answers: int = 1) -> str:
    """CTEs `tok` (one row per token) and `ex` (one row per example)."""
    salts = salts or {"target": 0}
    runs = ", ".join(f"('{r}', {s})" for r, s in salts.items())
    return f"""
ex AS (
  SELECT r.run, r.salt, d.source, d.doc_id AS index, a.answer_idx,
         string_split_regex(d.text, '{WORD_SPLIT}') AS words
  FROM documents d, (VALUES {runs}) r(run, salt), range({answers}) a(answer_idx)),
raw AS (
  SELECT run, salt, source, index, answer_idx, len(words) AS n,
         unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos
  FROM ex),
tok AS (
  SELECT run, source, index, answer_idx, pos, word,
         CASE WHEN pos >= least({PROMPT_WORDS}, n - 1) THEN length(word) ELSE -100 END AS label_id,
         -(((index * 31 + pos * 17 + salt + answer_idx * 7) % 97) + 1)::DOUBLE / 32.0::DOUBLE AS logprob,
         length(word) + CASE WHEN (index + pos + salt) % 3 = 0 THEN 1 ELSE 0 END AS pred_id,
         -(((index + pos * 5 + salt) % 31) + 1)::DOUBLE / 16.0::DOUBLE AS mu,
         ((index * 3 + pos + salt) % 13)::DOUBLE / 8.0::DOUBLE AS sigma2
  FROM raw),
loss AS (
  SELECT run, source, index, answer_idx, -sum(logprob) / count(*) AS avg_loss
  FROM tok WHERE label_id <> -100 GROUP BY ALL),
scored AS (
  SELECT * FROM (
    SELECT *, max(pos) OVER (PARTITION BY run, index, answer_idx) AS last_pos
    FROM tok WHERE label_id <> -100)
  WHERE pos < last_pos)"""


# ---------------------------------------------------------------- populations

def with_population(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Forget = labelled good quality; every other document is holdout."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"), "quality")
    return df.join(labels, "index", "left").withColumn(
        "population", F.when(F.col("quality") == 1, "forget").otherwise("holdout")
    ).drop("quality")


POPULATION_SQL = """
pop AS (
  SELECT d.doc_id AS index, CASE WHEN l.quality = 1 THEN 'forget' ELSE 'holdout' END AS population
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


# ---------------------------------------------------------------- questions and answers

def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_key, question, answer): each user turn with the assistant turn after it."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    # both keys together are unique, so a hot conversation is spread over tasks
    return users.join(replies, ["conv_id", "turn"]).select(
        (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("item_key"), "question", "answer"
    )


QA_SQL = """
qa AS (
  SELECT u.conv_id * 1048576 + u.turn AS item_key, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, input, ground_truth, generation): the answer with every fifth word
    dropped and every seventh swapped for a word of the question."""
    qa = spread(qa_pairs(spark, sf_dir), "item_key")
    words = F.split("ground_truth", WORD_SPLIT)
    asked = F.split("input", WORD_SPLIT)
    return (
        qa.select(
            F.col("item_key").alias("index"),
            F.col("question").alias("input"),
            F.col("answer").alias("ground_truth"),
        )
        .withColumn("_asked", asked)
        .withColumn(
            "_kept",
            F.filter(
                F.transform(
                    words,
                    lambda w, i: F.when(i % 5 == 4, F.lit(None))
                    .when(i % 7 == 3, F.get(F.col("_asked"), i % F.size("_asked")))
                    .otherwise(w),
                ),
                lambda w: w.isNotNull(),
            ),
        )
        .select("index", "input", "ground_truth", F.array_join("_kept", " ").alias("generation"))
    )


GENERATIONS_SQL = QA_SQL + r""",
gen AS (
  SELECT item_key AS index, question AS input, answer AS ground_truth,
         array_to_string(list_filter(list_transform(string_split_regex(answer, '[ \n\t]+'),
           lambda w, i: CASE WHEN (i - 1) % 5 = 4 THEN NULL
             WHEN (i - 1) % 7 = 3 THEN
               string_split_regex(question, '[ \n\t]+')[(i - 1) % len(string_split_regex(question, '[ \n\t]+')) + 1]
             ELSE w END), lambda w: w IS NOT NULL), ' ') AS generation
  FROM qa)"""


def scores_by_example(spark: SparkSession, sf_dir: str, salts: dict[str, int], answers: int) -> DataFrame:
    """(run, source, index, answer_idx, avg_loss, prob) for every document."""
    from lethe.operators.aggregates import losses_from_tokens

    return losses_from_tokens(
        token_rows(spark, sf_dir, salts, answers), ["run", "source", "index", "answer_idx"]
    )
