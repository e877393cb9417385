"""Triples to questions and answers with popularity counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe import schemas
from lethe.functions import questions as Q
from lethe.functions.text import strip
from lethe.operators.lookup import Lookup, lookup
from lethe.operators.order import keep_first, rank_with_ties
from lethe.session import materialise

FIELDS = ("subjectLabel", "relation", "objectLabel")
POSITION = ("file_path", "block_start", "row_in_block")

# Reasons in the table of missed rows.
EMPTY_CELL = "empty cell"
NO_QUESTION = "no QA generated"
QUESTION_ERROR = "generate_question error: "


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"columns {absent} not found; available: {df.columns}")
    return df


def clean_triples(df: DataFrame) -> DataFrame:
    """Strip the three text columns and flag rows with an empty one in `reason`."""
    require_columns(df, FIELDS)
    stripped = df.select(
        *[c for c in df.columns if c not in FIELDS],
        *[F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in FIELDS],
    )
    empty = F.greatest(*[(F.col(c) == "") for c in FIELDS])
    return stripped.withColumn("reason", F.when(empty, EMPTY_CELL))


def entity_key(label: Column) -> Column:
    return F.lower(strip(label))


def valid_entity_id(qid: Column) -> Column:
    return F.coalesce(qid.rlike(r"^Q\d+$"), F.lit(False))


def label_universe(df: DataFrame) -> DataFrame:
    """Distinct subject and object labels without regard to case."""
    labels = df.select(F.explode(F.array("subjectLabel", "objectLabel")).alias("label"))
    return labels.groupBy(entity_key(F.col("label")).alias("label_key")).agg(F.min("label").alias("label"))


def distinct_ids(df: DataFrame, column: str = "qid") -> DataFrame:
    return df.select(column).where(valid_entity_id(F.col(column))).dropDuplicates()


def entity_dimension(entity_labels: DataFrame) -> DataFrame:
    """One id per label: the smallest number wins where several match."""
    number = F.substring("qid", 2, 18).cast("long")
    valid = entity_labels.where(valid_entity_id(F.col("qid")))
    return valid.groupBy(entity_key(F.col("label")).alias("label_key")).agg(F.min_by("qid", number).alias("qid"))


def popularity_dimension(entity_popularity: DataFrame) -> DataFrame:
    """One row per id; of repeated bindings the greatest counts are taken."""
    return entity_popularity.groupBy("qid").agg(
        F.max("sitelinks").cast("int").alias("sitelinks"), F.max("identifiers").cast("int").alias("identifiers")
    )


def _both_sides(df: DataFrame, dim: DataFrame, dim_key: str, key, columns: Sequence[str]) -> DataFrame:
    """Look up subject and object in the same dimension."""
    sides = [
        Lookup(dim, dim_key, key(side), {c: f"{side}_{c}" for c in columns}) for side in ("subject", "object")
    ]
    return lookup(df, *sides)


def _label_key(side: str) -> Column:
    return entity_key(F.col(f"{side}Label"))


def link_entities(df: DataFrame, entity_labels: DataFrame) -> DataFrame:
    """Add subject_qid and object_qid; null where no label matches."""
    return _both_sides(df, entity_dimension(entity_labels), "label_key", _label_key, ["qid"])


def with_popularity_sums(df: DataFrame) -> DataFrame:
    for side in ("subject", "object"):
        for count in ("sitelinks", "identifiers"):
            df = df.withColumn(f"{side}_{count}", F.coalesce(F.col(f"{side}_{count}"), F.lit(0)))
        df = df.withColumn(f"{side}_popularity", F.col(f"{side}_sitelinks") + F.col(f"{side}_identifiers"))
    return df.withColumn("popularity_sum", F.col("subject_popularity") + F.col("object_popularity"))


def attach_popularity(df: DataFrame, entity_popularity: DataFrame) -> DataFrame:
    """Add link and identifier counts of both sides; 0 where the id is unknown."""
    dim = popularity_dimension(entity_popularity)
    found = _both_sides(df, dim, "qid", lambda side: F.col(f"{side}_qid"), ["sitelinks", "identifiers"])
    return with_popularity_sums(found)


def link_with_popularity(df: DataFrame, entity_labels: DataFrame, entity_popularity: DataFrame) -> DataFrame:
    """Ids and counts in one lookup per side: the two dimensions are joined first."""
    dim = entity_dimension(entity_labels).join(popularity_dimension(entity_popularity), "qid", "left")
    return with_popularity_sums(
        _both_sides(df, dim, "label_key", _label_key, ["qid", "sitelinks", "identifiers"])
    )


def with_questions(
    df: DataFrame, relation_tags: DataFrame, object_tags: DataFrame, reverse: bool = False
) -> DataFrame:
    """Add question, answer and the reason where there is none.

    Annotations are per distinct text, so the taggers never see a text twice.
    With `reverse` a column `topic` gives the swapped question where the
    forward one fails.  The annotated relations are broadcast: they are few, and
    one may hold most triples.
    """
    r = relation_tags.select(
        "relation",
        Q.relation_form(F.col("tags")).alias("_form"),
        *[
            Q.base_verbs(F.col("tokens"), F.col("tags"), F.col("lemmas"), tag).alias(name)
            for name, tag in (("_past", "VBD"), ("_present", "VBZ"))
        ],
        F.lit(True).alias("_tagged"),
    )
    o = object_tags.select(
        F.col("object").alias("objectLabel"), Q.agreed_type(F.col("ner1"), F.col("ner2")).alias("_object")
    )
    tagged = lookup(df, Lookup(o, "objectLabel", F.col("objectLabel")), Lookup(F.broadcast(r), "relation", F.col("relation")))
    object_type = F.col("_object.type")
    word = Q.question_word(object_type)
    subject, relation = F.col("subjectLabel"), F.col("relation")
    question = Q.forward_question(F.col("_form"), word, subject, relation, F.col("_past"), F.col("_present"))
    if reverse:
        topic = F.col("topic") if "topic" in df.columns else F.lit(None).cast("string")
        question = F.coalesce(
            question, Q.reverse_question(F.col("_form"), word, object_type, subject, relation, topic)
        )
    kept = F.coalesce(F.col("_object.keep"), F.lit(True))
    unread = F.col("_tagged").isNull()
    asked = tagged.withColumn("question", F.when(F.col("reason").isNull() & kept, question))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(unread, F.concat(F.lit(QUESTION_ERROR), F.lit("relation without annotation")))
        .when(F.col("question").isNull(), NO_QUESTION)
    )
    return (
        asked.withColumn("reason", reason)
        .withColumn("answer", F.when(F.col("question").isNotNull(), F.col("objectLabel")))
        .drop("_form", "_past", "_present", "_tagged", "_object")
    )


def dedup_keep_first(df: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """First row per triple, then first row per question and answer."""
    by_triple = keep_first(df, list(FIELDS), order)
    return keep_first(by_triple, ["question", "answer"], order)


def missed_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("reason").isNotNull()).select(*schemas.MISSED.names)


def build_qa(
    triples: DataFrame,
    relation_tags: DataFrame,
    object_tags: DataFrame,
    entity_labels: DataFrame,
    entity_popularity: DataFrame,
    order: Sequence[str] = POSITION,
    reverse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, missed).  Repeated triples are dropped before the entity
    lookups: everything later depends on the triple alone.  The rows with their
    questions are stored once, as both outputs and the lookups read them."""
    asked = materialise(with_questions(clean_triples(triples), relation_tags, object_tags, reverse), "asked")
    accepted = asked.where(F.col("reason").isNull()).drop("reason")
    first = keep_first(accepted, list(FIELDS), order)
    linked = link_with_popularity(first, entity_labels, entity_popularity)
    qa = keep_first(linked, ["question", "answer"], order)
    return qa.select(*order, *schemas.QA.names), missed_rows(asked)


def popularity_splits(df: DataFrame, percents: Sequence[int] = (1, 5, 10), value: str = "popularity_sum", key: str = "index") -> DataFrame:
    """(split, row...): rare and popular forget sets and what is left to retain.

    The lowest p % by popularity are rare, the highest popular, the middle
    100-2p % the retained intersection; ties go by key.  `df` is read several
    times: give a stored table.
    """
    ranked = rank_with_ties(df, value, key, "_rank").withColumn("_rows", df.agg(F.count("*")).scalar())

    def named(p: int) -> Column:
        size = F.floor(F.col("_rows") * p / 100)
        return (
            F.when(F.col("_rank") < size, f"rare_forget{p}")
            .when(F.col("_rank") >= F.col("_rows") - size, f"popular_forget{p}")
            .otherwise(f"retain_intersection{100 - 2 * p}")
        )

    splits = F.explode(F.array(*[named(p) for p in percents]))
    return ranked.withColumn("split", splits).drop("_rank", "_rows")
