"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Texts are counted in words and cut into blocks.  Every source gets a target in
words and from it an exact quota of block draws: whole passes over the source
and a part of one more, taken in a keyed order.  A binary tree splits the vector
of quotas among the output shards, each node drawing its left share from a
multivariate hypergeometric law, so that every shard holds an exact number of
draws and the shards together hold exactly the quotas.  A draw finds its shard
by walking down the tree; the shards take disjoint stretches of the keyed order
and shuffle locally.

Per-source totals (one row per source) pass through the driver; rows about
documents and blocks do not.  All choices are functions of a seed and the data,
so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # a source is repeated so many times at most
BLOCK_WORDS = 128
SHARDS = 64
ROWS_PER_BUCKET = 1_000_000
NUMPY_LIMIT = 10**9  # of its hypergeometric law
DEVIATIONS = 12  # from the mode; what lies beyond is less likely than a double can tell


@dataclass(frozen=True)
class Target:
    source: str | None
    size: int
    words: float

    @property
    def passes(self) -> int:
        return int(self.words // self.size) if self.size else 0


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, most: int = MOST) -> list[Target]:
    """Sources by code point, null last, weigh `weights`, repeating, and share all
    words; none gets more than `most` times its size, the excess goes to the
    others by weight.  Sources that fill up do so in the order of size by weight."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    left, shares = sum(n for _, n in ordered), sum(weight.values())
    words = {}
    for source, n in sorted(ordered, key=lambda s: s[1] / weight[s[0]]):
        if weight[source] * left <= most * n * shares:
            break
        words[source] = float(most * n)
        left -= most * n
        shares -= weight[source]
    return [Target(s, n, words.get(s, (weight[s] * left) / shares if shares else 0.0)) for s, n in ordered]


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """Good ones among `n` draws without replacement, for numbers of any size.

    Beyond numpy's limit by inversion: the law's ratios of neighbours, multiplied
    up around its mode, some square root of the draws long.
    """
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high, total = max(0, n - bad), min(good, n), good + bad
    mode = (good + 1) * (n + 1) // (total + 2)
    reach = 20 + int(DEVIATIONS * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1)))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(sums, rng.random() * sums[-1], side="right")), last - first)


def drawn_left(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `n` draws without replacement come from each source, one source
    after the other."""
    if int(quotas.sum()) < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, quota in enumerate(quotas.tolist()):
        rest -= quota
        out[i] = hypergeometric(quota, rest, n, rng)
        n -= int(out[i])
    return out


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Per source, the draws that go left at each node; node 1 is the root, the
    children of node k are 2k and 2k + 1, `shards` (a power of two) leaves follow."""
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    at = {1: np.array(quotas, dtype=np.int64)}
    left = np.zeros((len(quotas), max(2, shards)), dtype=np.int64)
    for node in range(1, shards):
        own = at.pop(node)
        share = drawn_left(own, int(own.sum()) // 2, np.random.default_rng([seed, node]))
        left[:, node] = share
        at[2 * node], at[2 * node + 1] = share, own - share
    return left.tolist()


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None) -> DataFrame:
    """(row, id, source, size, tie), stored: one row per document, no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    narrow = docs.select(
        row.alias("row"),  # fixed once it is written
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    return materialise(narrow, "mix-sizes")


def _blocks(sized: DataFrame, block_words: int | None) -> DataFrame:
    """One row per block of a document with words; `key` gives the order of draws."""
    size = F.col("size")
    per = size if block_words is None else F.lit(block_words).cast("bigint")
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(size / F.col("per")) - 1))
    cut = sized.where(size > 0).select("*", per.alias("per")).select("*", number.alias("block"))
    return cut.select(
        "row", "id", "source", "size", "tie", "block",
        F.least(F.col("per"), size - F.col("block") * F.col("per")).alias("words"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("block").cast("string"))).alias("key"),
    )


def _placed(blocks: DataFrame, hex_digits: int) -> DataFrame:
    """Add `words_before` and `blocks_before` within the source in the keyed order.

    A source of any size is spread over buckets of the key; windows run inside
    a bucket, and one row per source and bucket gives the offsets.
    """
    bucketed = blocks.withColumn("bucket", F.substring("key", 1, hex_digits))
    earlier = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("no", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("b"))
    offsets = sums.select(
        "no",
        "bucket",
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"),
    )
    inside = Window.partitionBy("no", "bucket").orderBy("key", "tie", "block", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(offsets, ["no", "bucket"])
        .withColumn("words_before", F.coalesce(F.sum("words").over(inside), F.lit(0)) + F.col("w0"))
        .withColumn("blocks_before", F.coalesce(F.count("*").over(inside), F.lit(0)) + F.col("b0"))
        .drop("w0", "b0", "bucket")
    )


@dataclass(frozen=True)
class Mix:
    """`documents` (row, id, source, size), `sources` (no, source, source_size, target,
    passes, rest, n_blocks, quota, left) and `draws`
    (row, id, source, size, block, words, epoch, shard, place)."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame


def mix(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 7,
    block_words: int | None = BLOCK_WORDS,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> Mix:
    """Plan the mix of all documents.

    Blocks hold up to `block_words` words, or a whole document each when that is
    None.  A source's drawn words differ from its target by half a block at most.
    A null text has no words and is never drawn; null sources are one source;
    null or repeated ids are told apart by row (`row_col`, where the caller has
    stored a unique one); an empty table gives empty results.
    """
    spark = docs.sparkSession
    sized = _sized(docs, id_col, text_col, source_col, row_col)
    plan = targets([(r["source"], r["size"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()], weights, most)
    number_rows = [(i, t.source, t.size, t.words, t.passes, t.words - t.passes * t.size) for i, t in enumerate(plan)]
    fields = "no int, source string, source_size bigint, target double, passes int, rest double"
    named = spark.createDataFrame(number_rows, fields).withColumnRenamed("source", "_source")
    total = sum(t.size for t in plan)
    hex_digits = 2
    while 16**hex_digits * ROWS_PER_BUCKET * (block_words or 1) < total:
        hex_digits += 1
    blocks = _blocks(sized, block_words).join(named, F.col("source").eqNullSafe(F.col("_source")))
    # of one more pass, the blocks whose middle lies before the target
    again = 2.0 * F.col("words_before") + F.col("words") <= 2.0 * F.col("rest")
    placed = materialise(
        _placed(blocks, hex_digits).select(
            "row", "id", "no", "source", "size", "block", "words", "blocks_before", (F.col("passes") + again.cast("int")).alias("times"), again.alias("again")
        ),
        "mix-blocks",
    )
    counted = {
        r["no"]: (r["blocks"], r["again"])
        for r in placed.groupBy("no").agg(F.count("*").alias("blocks"), F.sum(F.col("again").cast("bigint")).alias("again")).collect()
    }
    # the draws of a source, pass after pass, hold the places 0 .. quota - 1
    full = [counted.get(i, (0, 0))[0] for i in range(len(plan))]
    quotas = [t.passes * n + counted.get(i, (0, 0))[1] for i, (t, n) in enumerate(zip(plan, full))]
    tree = splitting_tree(quotas, shards, seed) if plan else []
    sources = spark.createDataFrame(
        [(*row, n, q, left) for row, n, q, left in zip(number_rows, full, quotas, tree)],
        f"{fields}, n_blocks bigint, quota bigint, left array<bigint>",
    )
    draws = (
        placed.where(F.col("times") > 0)
        .join(sources.select("no", "n_blocks", "left"), "no")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
        .withColumn("_p", F.col("epoch") * F.col("n_blocks") + F.col("blocks_before"))
        .withColumn("_node", F.lit(1))
    )
    for _ in range(shards.bit_length() - 1):
        draws = draws.withColumn("_left", F.get("left", F.col("_node")))
        right = F.col("_p") >= F.col("_left")
        draws = draws.withColumn("_node", 2 * F.col("_node") + right.cast("int")).withColumn(
            "_p", F.col("_p") - F.when(right, F.col("_left")).otherwise(F.lit(0))
        )
    drawn = draws.select(
        "row", "id", "source", "size", "block", "words", "epoch",
        (F.col("_node") - shards).alias("shard"),
        F.xxhash64(F.lit(seed), "no", "row", "block", "epoch").alias("place"),
    )
    return Mix(sized, sources, drawn)


def shuffled(draws: DataFrame, shards: int, shard: str = "shard", place: str = "place") -> DataFrame:
    """The draws, one partition per group of shards, in each shard's shuffled order."""
    return draws.repartition(shards, shard).sortWithinPartitions(shard, place)


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7, **columns: str | None) -> DataFrame:
    """The columns of `docs`, each row as often as the mix draws it, whole documents at a time:
    one partition per group of shards, each shard in its shuffled order.

    The documents are stored once under a row number and meet their draws by it.
    """
    numbered = materialise(docs.select("*", F.monotonically_increasing_id().alias("_mix_row")), "mix-documents")
    chosen = mix(numbered, shards, seed, None, **columns, row_col="_mix_row").draws
    draws = chosen.select(F.col("row").alias("_mix_row"), F.col("shard").alias("_mix_shard"), F.col("place").alias("_mix_place"))
    return shuffled(numbered.join(draws, "_mix_row"), shards, "_mix_shard", "_mix_place").select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS wt FROM s),
o AS (
  SELECT *, sum(n) OVER () - 3 * coalesce(sum(n) OVER before, 0) AS remaining,
    sum(wt) OVER () - coalesce(sum(wt) OVER before, 0) AS shares
  FROM w WINDOW before AS (ORDER BY n::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, wt * remaining > 3 * n * shares AS capped FROM o),
f AS (
  SELECT (sum(n) - 3 * coalesce(sum(n) FILTER (WHERE capped), 0)) AS remaining,
    sum(wt) FILTER (WHERE NOT capped) AS shares FROM c),
t AS (
  SELECT c.source, c.n, CASE WHEN capped THEN (3 * c.n)::DOUBLE
    ELSE (c.wt * f.remaining)::DOUBLE / f.shares::DOUBLE END AS target
  FROM c, f),
b AS (
  SELECT d.doc_id, d.source, d.size, i, least(128, d.size - i * 128) AS words, md5(d.doc_id || ':' || i) AS key
  FROM d, LATERAL (SELECT unnest(range(greatest((d.size + 127) // 128, 1))) AS i)),
p AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b),
k AS (
  SELECT p.doc_id, p.size, t.n, t.target, p.words,
    floor(t.target / t.n) + CASE WHEN p.words > 0
      AND 2.0::DOUBLE * p.before + p.words <= 2.0::DOUBLE * (t.target - floor(t.target / t.n) * t.n) THEN 1 ELSE 0 END AS times
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
  sum(CASE WHEN words > 0 THEN words * times ELSE 0 END)::BIGINT AS taken
FROM k GROUP BY ALL"""


@query("op7_mixing_tree", SQL)
def mixing_tree(spark, sf_dir):
    planned = mix(table(spark, sf_dir, "documents"), SHARDS)
    per_shard = planned.draws.groupBy("row", "shard").agg(F.sum("words").alias("words"))
    # a draw counts where the tree has put it
    taken = per_shard.where(F.col("shard").between(0, SHARDS - 1)).groupBy("row").agg(F.sum("words").alias("taken"))
    facts = planned.sources.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        planned.documents.join(taken, "row", "left")
        .join(facts, F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )
