"""Hard negatives of anchors by a secondary-sort shuffle.

Pair scores travel under the key (anchor, falling score, positives first, id).
They are dealt to partitions by anchor and sorted inside them by the whole key,
so one walk over a partition meets the pairs of an anchor from its best score
downwards: a positive opens a window of scores below its own, a negative is
given out in every open window that it falls into and that still has room.  The
walk holds the few windows of one anchor, never its pairs.

Before that shuffle each block of rows keeps only what can still come out: its
best rows of the anchor's label, and, once the positives are known, its best
rows of other labels in each window.  An anchor's pairs are thus a few per
block, whatever the number of rows, and no row that could be returned is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.llm.voronoi_knn import products
from lethe.session import materialise

GROUP_ANCHORS = 2_048
BLOCK_ROWS = 16_384
CELLS = 4_000_000  # scores held at once


def scaled(vectors: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, x as double; shorter vectors filled up with zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale).astype(np.int64)


def leading(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, falling, ties by place."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.argsort(-scores[some], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")


def _pairs(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["anchor", "score", "id"], dtype="int64")


def block_positives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, dims: int, scale: int) -> pd.DataFrame:
    """The k best rows of a block that carry each anchor's label, its own id left out."""
    found = []
    rows = rows.sort_values("id", kind="stable")
    for label, asked in anchors.groupby("label"):
        same = rows[rows["label"] == label]
        if same.empty:
            continue
        data, ids = scaled(same["v"], dims, scale), same["id"].to_numpy()
        step = max(1, CELLS // len(ids))
        for at in range(0, len(asked), step):
            part = asked.iloc[at : at + step]
            for anchor, own, line in zip(part["anchor"], part["id"], products(scaled(part["v"], dims, scale), data)):
                others = np.flatnonzero(ids != own)
                best = others[leading(line[others], k)]
                found += [(anchor, s, i) for s, i in zip(line[best].tolist(), ids[best].tolist())]
    return _pairs(found)


def block_negatives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, dims: int, scale: int, low: int, high: int) -> pd.DataFrame:
    """The k best rows of a block with another label in the window of each positive score."""
    found = []
    if len(anchors) and len(rows):
        rows = rows.sort_values("id", kind="stable")
        data, ids, labels = scaled(rows["v"], dims, scale), rows["id"].to_numpy(), rows["label"].to_numpy()
        step = max(1, CELLS // len(ids))
        for at in range(0, len(anchors), step):
            part = anchors.iloc[at : at + step]
            lines = products(scaled(part["v"], dims, scale), data)
            for anchor, label, windows, line in zip(part["anchor"], part["label"], part["windows"], lines):
                other, kept = labels != label, set()
                for p in {int(p) for p in windows}:
                    inside = np.flatnonzero(other & (100 * line >= low * p) & (100 * line <= high * p))
                    kept.update(inside[leading(line[inside], k)].tolist())
                found += [(anchor, int(line[at_]), int(ids[at_])) for at_ in sorted(kept)]
    return _pairs(found)


def walk(batches: Iterator[pd.DataFrame], negatives: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    """Triples from pairs in the order of their key; holds one anchor's windows at a time."""
    current, windows = None, []
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for batch in batches:
        out = []
        columns = (batch[c].tolist() for c in ("anchor", "anchor_id", "falling", "kind", "id"))
        for anchor, anchor_id, falling, kind, row in zip(*columns):
            if anchor != current:
                current, windows = anchor, []
            if kind == 0:
                windows.append([row, -falling, 0])
                continue
            for window in windows:
                positive, top, given = window
                if given < negatives and low * top <= -100 * falling <= high * top:
                    window[2] += 1
                    out.append((anchor_id, positive, given + 1, row, top, -falling))
        yield pd.DataFrame(out, columns=names)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str | Column = "label",
    vector_col: str = "embedding",
    group_anchors: int = GROUP_ANCHORS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * component).  The positives of a row
    where `anchors` holds are its `positives` best rows of the same label and
    another id; for each one the `negatives` best rows of other labels with
    low % to high % of the positive's score are returned, all if there are fewer.
    Better is a higher score, then a smaller id.

    Null ids, labels and vectors and vectors with null or non-finite components
    take no part.  Shorter vectors, empty ones too, count as filled up with
    zeros.  A repeated row is a candidate each time and an anchor once; rows that
    share an id but differ are anchors each on its own.  A positive with a score
    below zero has an empty window.  Other columns are not read; an empty table,
    or one without anchors, gives no rows.  Scores have to fit a long.
    """
    vector = F.col(vector_col)
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & usable)
    # numbers of anchors are written down, so that they are the same for every reader
    asked = materialise(
        rows.where("asks").select("id", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors"
    )
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    blocks = max(1, -(-total["n"] // block_rows))
    groups = max(1, -(-asked.count() // group_anchors))
    dims = total["dims"]
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("grp")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("grp")
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block")
    dealt = rows.select("id", "label", "v", block, every_group).groupBy("grp", "block")

    def in_blocks(questions: DataFrame, solve) -> DataFrame:
        return (
            questions.select("*", group, every_block)
            .groupBy("grp", "block")
            .cogroup(dealt)
            .applyInPandas(solve, "anchor bigint, score bigint, id bigint")
        )

    nearest = in_blocks(asked, lambda a, x: block_positives(a, x, positives, dims, scale))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    chosen = materialise(nearest.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "positives")
    windows = chosen.groupBy("anchor").agg(F.collect_list("score").alias("windows"))
    hard = in_blocks(asked.join(windows, "anchor"), lambda a, x: block_negatives(a, x, negatives, dims, scale, low, high))
    pairs = chosen.withColumn("kind", F.lit(0)).unionByName(hard.withColumn("kind", F.lit(1)))
    keyed = pairs.join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor", (-F.col("score")).alias("falling"), "kind", "id", "anchor_id"
    )
    ordered = keyed.repartition("anchor").sortWithinPartitions("anchor", "falling", "kind", "id")
    return ordered.mapInPandas(
        lambda batches: walk(batches, negatives, low, high),
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same,
    list_sum(list_transform(list_zip(a.c, x.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 50 = 0 AND x.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op12_hard_negatives", SQL)
def hard_negatives(spark, sf_dir):
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=turned)
