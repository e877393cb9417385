"""Connected components of an edge table by alternating stars, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.session import materialise

MOST_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(
        "e.a", "e.b"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); `root` is its smallest reachable node.

    Each round hangs the larger neighbours of a node on its smallest one, then
    the smaller ones; the number of rounds grows with the logarithm of the
    longest chain.  Minima are taken before the shuffle, so a hub costs one row
    per task; no neighbourhood is gathered.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        every = _both(edges)
        low = every.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = every.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        edges = materialise(
            small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct(),
            "edges",
        )
        after = _state(edges)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
