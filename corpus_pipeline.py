"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Every stage takes all that its predecessor kept, whole texts, and its decisions
take effect: toxic documents go, one document of each group of near duplicates
stays, personal data are replaced, sources are drawn to their target weights,
and what is drawn is encoded.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import coordinate_join, forced_boundary, mixing_tree, surrogates, toxicity
from lethe.session import materialise

# Learned models, keyed surrogates and token ids are beyond SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on labelled documents (held-out ones apart) and keep what is not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.labelled_rows(docs, labels, "toxic", ~toxicity.held_out(), toxicity.MAX_ROWS)
    return toxicity.without_toxic(docs, toxicity.train(rows))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group; five words, similarity of 0.8 or more."""
    return coordinate_join.keep_one(docs, words=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_entities(docs)
    length = F.when(F.col("n_entities") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix draws them."""
    return mixing_tree.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = forced_boundary.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document drawn from what the stages kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
