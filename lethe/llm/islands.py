"""Links inside of islands: classes that lists connect, searched by count-vector trees.

A task holds the sets of a leaf, or of two leaves, of an island.  Points of counts
per group of shared shingles are packed into nodes; the summed coordinate minima
of two corners, and of two points, bound what sets share, and what survives is
verified.  Only links that join two components are given out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.components import components
from lethe.llm.members import likely
from lethe.session import materialise

GROUPS = 2_048
NODE = 32
LEAF_ROWS = 512
LEAF_SHINGLES = 1_000_000


# ---------------------------------------------------------------- inside one task


def shared_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of every row of `a` with every row of `b`."""
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for k in range(1, int(min(a.max(initial=0), b.max(initial=0))) + 1):
        total += (a >= k).astype(np.float32) @ (b >= k).astype(np.float32).T
    return total


def count_points(sets: list[np.ndarray], groups: int) -> np.ndarray:
    """Counts per group of the shingles that at least two of the sets hold; every
    such shingle has a group of its own where they are few enough."""
    sizes = [len(s) for s in sets]
    _, place, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = met > 1
    number = (np.cumsum(several) - 1)[place]
    kept = several[place]
    groups = max(1, min(groups, int(several.sum())))
    cell = np.repeat(np.arange(len(sets)), sizes)[kept] * groups + number[kept] % groups
    return np.bincount(cell, minlength=len(sets) * groups).reshape(len(sets), groups)


def tree_links(
    sets: list[np.ndarray], joined: np.ndarray, sides: np.ndarray, percent: int, groups: int = GROUPS, node: int = NODE
) -> list[tuple[int, int]]:
    """Links (i, j) of similar sets that join all components which similar sets join.

    `joined` names the component that a set is in already; with two `sides` only
    pairs from both are compared.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2 or (joined == joined[0]).all():
        return []
    points = count_points(sets, groups)
    order = np.lexsort((sizes, joined))
    runs = [order[at : at + node] for at in range(0, len(order), node)]
    corners = np.array([points[r].max(0) for r in runs])
    least, most = np.array([sizes[r].min() for r in runs]), np.array([sizes[r].max() for r in runs])
    low, high = np.array([joined[r].min() for r in runs]), np.array([joined[r].max() for r in runs])
    lone = low == high
    open_ = (100 + percent) * shared_counts(corners, corners) >= percent * (least[:, None] + least)
    open_ &= (100 * most[:, None] >= percent * least) & (100 * most >= percent * least[:, None])
    open_ &= ~(lone[:, None] & lone & (low[:, None] == low))
    candidates = []
    for x, y in zip(*np.nonzero(np.triu(open_))):
        a, b = runs[x], runs[y]
        shared = shared_counts(points[a], points[b])
        both = sizes[a][:, None] + sizes[b]
        fits = ((100 + percent) * shared >= percent * both) & (joined[a][:, None] != joined[b])
        if sides.any() and not sides.all():
            fits &= sides[a][:, None] != sides[b]
        if x == y:
            fits = np.triu(fits, 1)
        i, j = np.nonzero(fits)
        candidates.append(np.stack([a[i], b[j], -1000 * shared[i, j] / both[i, j]]))
    if not candidates:
        return []
    root = {c: c for c in set(joined.tolist())}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    every = np.concatenate(candidates, axis=1)
    for i, j in every[:2, np.argsort(every[2], kind="stable")].astype(int).T.tolist():
        p, q = find(int(joined[i])), find(int(joined[j]))
        if p == q:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (sizes[i] + sizes[j] - both):
            root[max(p, q)] = min(p, q)
            links.append((i, j))
    return links


def _solver(percent: int, groups: int, node: int):
    """Links of every task; rows come sorted by task and a task's rows are held alone."""

    def solved(rows: list[tuple]) -> list[tuple[int, int]]:
        names = [r[0] for r in rows]
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        found = tree_links(sets, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), percent, groups, node)
        return [(names[i], names[j]) for i, j in found]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rows = None, []
        for batch in batches:
            out = []
            for island, la, lb, *row in batch[["island", "la", "lb", "c", "comp", "side", "held"]].itertuples(index=False):
                if (island, la, lb) != current:
                    out += solved(rows) if rows else []
                    current, rows = (island, la, lb), []
                rows.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(solved(rows) if rows else [], columns=["a", "b"], dtype="int64")

    return solve


# ---------------------------------------------------------------- islands


def island_links(
    members: DataFrame,
    sets: DataFrame,
    percent: int,
    groups: int = GROUPS,
    node: int = NODE,
    leaf_rows: int = LEAF_ROWS,
    leaf_shingles: int = LEAF_SHINGLES,
) -> DataFrame:
    """(a, b): similar classes that join all components which members of common lists join.

    `members` holds (token, c, n, comp): the lists of every class, its size and
    its component so far; `sets` (c, held) the sorted hashes.
    """
    mixed = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    waiting = materialise(members.join(mixed, "token").select("token", "c", "n", "comp"), "open-members")
    # an island is everything that lists connect
    first = waiting.groupBy("token").agg(F.min("c").alias("first"))
    ties = waiting.join(first, "token").select(F.col("first").alias("a"), F.col("c").alias("b")).where("a <> b").distinct()
    islands = materialise(components(ties).select(F.col("node").alias("c"), F.col("root").alias("island")), "islands")
    placed = waiting.join(islands, "c")
    band = 1.01 * math.log(100 / percent)  # sizes that can meet lie in the same or in neighbouring bands
    one = placed.groupBy("c", "island", "n", "comp").agg(F.min("token").alias("near"))
    one = materialise(one.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / band)), "island-members")
    parts = F.ceil(F.greatest(F.count("*") / leaf_rows, F.sum("n") / leaf_shingles))
    whole = one.groupBy("island").agg(parts.alias("parts")).where("parts > 1").select("island", F.lit(True).alias("large"))
    cut = one.groupBy("island", "band").agg(parts.alias("parts"))
    leaf = F.when(F.col("large"), F.col("band") * 2**32 + F.pmod(F.xxhash64("near", F.col("c") % 16), F.col("parts"))).otherwise(0)
    leaved = one.join(whole, "island", "left").join(cut, ["island", "band"]).select("c", "island", "comp", "band", leaf.cast("bigint").alias("leaf"))
    leaved = materialise(leaved, "leaves")
    # leaves meet where a list has members in both
    listed = waiting.select("token", "c").join(leaved, "c").groupBy("token", "island", "leaf").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = listed.select("token", *[F.col(x).alias(f"o_{x}") for x in ("leaf", "low", "high")])
    near = F.abs(F.shiftright("leaf", 32) - F.shiftright("o_leaf", 32)) <= 1
    lone = (F.col("low") == F.col("high")) & (F.col("o_low") == F.col("o_high")) & (F.col("low") == F.col("o_low"))
    met = listed.join(other, "token").where((F.col("leaf") <= F.col("o_leaf")) & near & ~lone)
    tasks = met.select("island", F.col("leaf").alias("la"), F.col("o_leaf").alias("lb")).distinct()
    sided = tasks.select("*", F.explode(F.array_distinct(F.array("la", "lb"))).alias("leaf"))
    rows = sided.join(leaved, ["island", "leaf"]).select("island", "la", "lb", "c", "comp", ((F.col("leaf") == F.col("lb")) & (F.col("la") < F.col("lb"))).alias("side"))
    ordered = rows.join(likely(sets.select("c", "held"), leaved.select("c"), "c"), "c").repartition("island", "la", "lb").sortWithinPartitions("island", "la", "lb")
    return ordered.mapInPandas(_solver(percent, groups, node), "a bigint, b bigint")
