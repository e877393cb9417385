"""Exact Jaccard join of shingle sets by R-trees over count vectors.

Documents with the same set form one class.  A set of n shingles may lack
m = n - ceil(t n) of them in a similar one, so a class with more than m that no
other class holds has no partner; a fixed quarter of all shingles shows that for
most classes, all shingles of the others for the rest.  In one order of the
shingles, rare ones first, two similar sets share one of the first m + 1 of
each, so the classes are posted under those.  A posting list says which classes
can meet at all; no list is enumerated.  Every
member is first compared with one pivot of its list, which joins most groups of
copies at a cost that grows with their members.  Lists that still hold unjoined
members are put together to islands, and an island is searched by trees:

* the shingles that at least two members hold are dealt to groups, and a member
  is the point of its counts per group;
* points are packed into nodes; a node's upper corner bounds its members, and
  the summed coordinate minima of two corners, or of two points, bound what
  their members share, since shingles of one member alone are never shared;
* pairs that survive the bound, and are not joined yet, are verified on their sets.

A task gives out only links that join two components, so its rows grow with its
members and not with their pairs.  Large islands are cut into leaves of bounded
size; pairs of leaves that share a list are solved each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.llm.components import components
from lethe.llm.coordinate_join import WordHashes, shingle_hashes
from lethe.llm.islands import island_links
from lethe.llm.members import likely
from lethe.session import materialise

SAMPLE = 0.25  # of the range of hashes; any share gives the same result


# ---------------------------------------------------------------- the join


def _sampler(words: int):
    """Size, digest and sampled shingles of every text.

    The sample holds the shingles whose hash lies in the lowest `SAMPLE` of the
    range, so a shingle is sampled in all of its documents or in none."""
    limit = np.uint64(int(SAMPLE * 2**64))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            n, same, some = [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, words, known)
                n.append(len(hashes))
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                some.append(hashes[: np.searchsorted(hashes, limit)].view(np.int64))
            yield batch[["id", "named", "body"]].assign(n=n, same=same, some=some)

    return sample


def _lister(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [np.frombuffer(x, dtype=np.int64) for x in batch["held"]]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pd.DataFrame({"c": np.repeat(batch["c"].to_numpy(), [len(x) for x in sets]), "token": tokens})


def _set_maker(words: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            yield batch[["c", "n", "m"]].assign(held=[shingle_hashes(t, words, known).tobytes() for t in batch["text"]])

    return make


def _verifier(percent: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["held_a"], batch["held_b"]):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[np.array(linked, dtype=bool), ["a", "b"]]

    return verify


def similar_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **tree: int
) -> DataFrame:
    """(`id_col`, n_shingles, component_id): one row per row of `docs`.

    Two documents are linked when the Jaccard similarity of their sets of
    `words`-word shingles is at least `percent` / 100; `component_id` is the
    smallest id reachable by links.  Null and empty texts, and texts without
    words, have a set of size 0, are linked with nothing and keep their own id.
    Null ids take part and are a component's id only where all are null.
    Repeated rows are linked; other columns are not read; an empty table gives
    no rows.  `tree` sets `groups`, `node`, `leaf_rows` and `leaf_shingles`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))
    # a null id would turn the ids of its batch into doubles
    passed = narrow.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "body", "text")
    sampled = passed.mapInPandas(_sampler(words), "id bigint, named boolean, body bigint, n bigint, same binary, some array<bigint>")
    signed = materialise(sampled.withColumn("id", F.when(F.col("named"), F.col("id"))), "samples")
    # a class with more than m sampled shingles of its own is similar to none; all copies
    # of a class are posted, which costs less than moving the samples to one of them
    key = F.xxhash64("same").alias("key")
    found = signed.where("n > 0").select(key, F.explode("some").alias("token"))
    several = found.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token")
    common = found.join(several.hint("merge"), "token").groupBy("key").agg(F.count("*").alias("common"))
    classes = materialise(
        signed.where("n > 0")
        .groupBy("same", key)
        .agg(
            F.min(F.struct(~F.col("named"), "id", "body")).alias("row"),
            F.first("n").alias("n"),
            F.sum(F.size("some")).alias("posted"),
            F.count("*").alias("copies"),
        )
        .select(F.monotonically_increasing_id().alias("c"), "same", "key", "row.id", "row.body", "n", "posted", "copies")
        .withColumn("m", F.col("n") - F.ceil(F.col("n") * percent / 100)),
        "set-classes",
    )
    own = F.col("posted") - F.coalesce("common", F.lit(0))
    wanted = materialise(
        classes.join(common, "key", "left")
        .where(own <= F.col("m") * F.col("copies"))
        .select("c", F.xxhash64(F.col("id").isNull(), "id").alias("v"), "body", "n", "m"),
        "candidates",
    )
    row_of = [F.xxhash64(F.col("id").isNull(), "id").alias("v"), "body"]
    # only the candidates' texts move; rows that repeat id and text collapse before the shuffle, which also serves the join
    once = likely(narrow.select(*row_of, "text"), wanted, "v", "body").dropDuplicates(["v", "body"])
    texts = once.join(wanted, ["v", "body"]).select("c", "n", "m", "text")
    sets = materialise(texts.mapInPandas(_set_maker(words), "c bigint, n bigint, m bigint, held binary"), "sets")
    # the same with all shingles of the candidates, which also gives the order of rarity
    tokens = sets.select("c", "held").mapInPandas(_lister, "c bigint, token bigint")
    several = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(several.hint("merge"), "token").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    room = F.col("m") + 1 - (F.col("n") - F.size("common"))
    first = F.slice("common", F.lit(1), room.cast("int"))
    posted = materialise(ranked.join(sets.select("c", "n", "m"), "c").where(room > 0).select("c", "n", F.explode(first)).select("c", "n", "col.token"), "postings")
    digests = F.count("*").alias("df"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")
    # lists of the same members are one list
    lists = posted.groupBy("token").agg(*digests).where("df > 1").groupBy("df", "x", "y").agg(F.min("token").alias("token"))
    members = materialise(posted.join(lists.select("token", "df"), "token"), "list-members")
    # every member with one pivot of its list, the same one in as many lists as possible
    pivots = members.groupBy("token").agg(F.min(F.struct(F.xxhash64("c").alias("h"), "c", "n")).alias("p")).select("token", "p.c", "p.n")
    met = members.join(pivots.select("token", F.col("c").alias("b"), F.col("n").alias("nb")), "token").where(F.col("c") != F.col("b"))
    pairs = met.where((100 * F.col("n") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("n"))).select(F.col("c").alias("a"), "b").distinct()
    pairs = materialise(pairs, "pivot-pairs")
    sided = [likely(sets.select(F.col("c").alias(x), F.col("held").alias(f"held_{x}")), pairs.select(x).distinct(), x) for x in "ab"]
    starred = materialise(pairs.join(sided[0], "a").join(sided[1], "b").mapInPandas(_verifier(percent), "a bigint, b bigint"), "pivot-links")
    roots = materialise(components(starred), "pivot-groups")
    # a list of two has no pair but the one with its pivot
    joined = members.where("df > 2").join(roots, F.col("c") == F.col("node"), "left")
    links = island_links(joined.select("token", "c", "n", F.coalesce("root", "c").alias("comp")), sets, percent, **tree)
    known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(known.union(links))
    rooted = classes.join(final, F.col("c") == F.col("node"), "left").select("same", "id", F.coalesce("root", "c").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("same").alias("_same"), "component_id")
    return signed.join(named, F.col("same") == F.col("_same"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + 3], ' ') END AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n"""


@query("op13_count_tree", SQL)
def count_tree(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)
