"""Exact top-k search by inner product as a Voronoi kNN join.

Queries and data are assigned to the cells of a bounded set of pivots.  From
one summary row per cell (count, radius, distances of the members nearest to
the pivot) follow, for every cell of queries, a score that its k best surely
reach and, for every cell of data, the distance from the pivot below which no
member can reach it.  Only the other members are copied to the query groups,
dealt into blocks of bounded size, solved block by block and merged.

With p, r for a pivot and a distance from it, every q near p1 and x near p2 has
|q.x - p1.p2| <= |p1| r2 + r1 |p2| + r1 r2, which gives both bounds.

Where vectors are so spread out that the bounds exclude nothing, all data go to
all query groups, in blocks; the result is exact either way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.session import materialise

PIVOTS = 64
GROUP_QUERIES = 2_048
BLOCK_ROWS = 16_384
SLACK = 1e-9  # of a bound's size, for rounding of square roots
EXACT = 2.0**53


def components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as bigint; null when the vector, or a
    component, is null or not finite."""
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & usable, scaled)


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _assigner(pivots: np.ndarray):
    dims = pivots.shape[1]

    def assign(batches):
        for batch in batches:
            x = _matrix(batch["v"], dims).astype(np.float64)
            far = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
            cell = far.argmin(1)
            yield pd.DataFrame(
                {"id": batch["id"], "v": batch["v"], "cell": cell, "dist": np.sqrt(((x - pivots[cell]) ** 2).sum(1)), "asks": batch["asks"]}
            )

    return assign


@dataclass(frozen=True)
class Plan:
    """`group_of[cell]`: (first group, number of groups) of the cell's queries;
    `reach[group, cell]`: least distance at which data of the cell are needed;
    `blocks[group]`: number of blocks its data are dealt into."""

    group_of: dict[int, tuple[int, int]]
    reach: np.ndarray
    blocks: list[int]


def make_plan(pivots: np.ndarray, data: dict, asks: dict, nearest: dict, k: int, group_queries: int, block_rows: int) -> Plan:
    """`data[cell]`: (rows, radius); `asks[cell]`: (queries, radius); `nearest[cell]`:
    the distances of up to k + 1 data rows nearest to the pivot."""
    norm = np.sqrt((pivots**2).sum(1))
    dots = pivots @ pivots.T
    reach = {}
    for i, (_, r1) in asks.items():
        def spread(j, r2, r1=r1, i=i):
            return norm[i] * r2 + r1 * norm[j] + r1 * r2

        sure = sorted((dots[i, j] - spread(j, d) for j, ds in nearest.items() for d in ds), reverse=True)
        # one of the rows may be the query itself, so k + 1 of them vouch for k others
        theta = sure[k] if len(sure) > k else -np.inf
        if np.isfinite(theta):
            theta -= SLACK * (abs(theta) + float(norm.max(initial=0)) ** 2 + 1)
        for j in data:
            slope = norm[i] + r1
            gap = theta - dots[i, j] - r1 * norm[j]
            if gap <= 0:
                reach[i, j] = 0.0
            else:
                reach[i, j] = gap / slope * (1 - SLACK) if slope > 0 else np.inf
    groups, current, held = [], [], 0
    group_of = {}
    for i in sorted(asks):
        n = asks[i][0]
        if n > group_queries:
            parts = -(-n // group_queries)
            group_of[i] = (len(groups), parts)
            groups += [[i]] * parts
        else:
            if not current or held + n > group_queries:
                current, held = [], 0
                groups.append(current)
            current.append(i)
            held += n
            group_of[i] = (next(g for g, members in enumerate(groups) if members is current), 1)
    cells = max([*data, *asks], default=-1) + 1
    table_ = np.full((len(groups), cells), np.inf)
    for g, members in enumerate(groups):
        for j in data:
            table_[g, j] = min(reach[i, j] for i in members)
    rows = [sum(n for j, (n, radius) in data.items() if table_[g, j] <= radius) for g in range(len(groups))]
    return Plan(group_of, table_, [max(1, -(-n // block_rows)) for n in rows])


def _router(plan: Plan):
    def route(batches):
        for batch in batches:
            cell, dist, ids = batch["cell"].to_numpy(), batch["dist"].to_numpy(), batch["id"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for g, blocks in enumerate(plan.blocks):
                near = np.flatnonzero(dist >= plan.reach[g, cell])
                if len(near):
                    yield pd.DataFrame(
                        {"grp": g, "block": (mixed[near] % np.uint64(blocks)).astype(np.int64), "id": ids[near], "v": batch["v"].iloc[near]}
                    )

    return route


def _asker(plan: Plan):
    def ask(batches):
        for batch in batches:
            out = {"grp": [], "block": [], "id": [], "v": []}
            for i, v, cell in zip(batch["id"], batch["v"], batch["cell"]):
                first, parts = plan.group_of[cell]
                g = first + (i * 0x9E3779B97F4A7C15 >> 20) % parts
                for b in range(plan.blocks[g]):
                    out["grp"].append(g)
                    out["block"].append(b)
                    out["id"].append(i)
                    out["v"].append(v)
            yield pd.DataFrame(out)

    return ask


def best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, dims: int) -> pd.DataFrame:
    """The k best rows of a block for each query, ties to the smaller id, own id left out."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(rows):
        rows = rows.sort_values("id", kind="stable")
        ids = rows["id"].to_numpy()
        data, asked = _matrix(rows["v"], dims), _matrix(queries["v"], dims)
        step = max(1, 4_000_000 // len(ids))
        own = queries["id"].to_numpy()
        for at in range(0, len(own), step):
            scores = products(asked[at : at + step], data)
            for q, line in zip(own[at : at + step], scores):
                lo, hi = np.searchsorted(ids, [q, q + 1])
                if hi > lo:
                    keep = np.r_[0:lo, hi : len(ids)]
                    line, names = line[keep], ids[keep]
                else:
                    names = ids
                if len(line) > k:
                    # every row that reaches the k-th score; ids ascend, so a stable sort breaks ties
                    some = np.flatnonzero(line >= np.partition(line, -k)[-k])
                    line, names = line[some], names[some]
                best = np.argsort(-line, kind="stable")[:k]
                out["query_id"] += [q] * len(best)
                out["vec_id"] += names[best].tolist()
                out["score"] += line[best].tolist()
    return pd.DataFrame(out, dtype="int64")


def top_k(
    vectors: DataFrame,
    asks: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    group_queries: int = GROUP_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `asks` holds, the k rows
    of other ids with the greatest inner product of components, all if there are fewer.

    Ties go to the smaller id.  Null ids, null vectors and vectors with null or
    non-finite components take no part; shorter vectors count as filled up with
    zeros; a repeated row is a candidate each time; other columns are not read;
    without queries or candidates there are no rows.
    """
    spark = vectors.sparkSession
    usable = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), components(F.col(vector_col)).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    # the pivots: rows with the smallest hashes, a bounded list
    chosen = usable.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(pivots).collect()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not chosen:
        return spark.createDataFrame([], result)
    dims = usable.agg(F.max(F.size("v"))).first()[0]
    centres = _matrix([r["v"] for r in chosen], dims).astype(np.float64)
    celled = materialise(
        usable.mapInPandas(_assigner(centres), "id bigint, v array<bigint>, cell int, dist double, asks boolean"), "knn-cells"
    )
    summary = celled.groupBy("cell", "asks").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()
    data, asked = {}, {}
    for r in summary:  # queries are data as well
        n, radius = data.get(r["cell"], (0, 0.0))
        data[r["cell"]] = (n + r["n"], max(radius, r["radius"]))
        if r["asks"]:
            asked[r["cell"]] = (r["n"], r["radius"])
    if not asked:
        return spark.createDataFrame([], result)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    nearest: dict[int, list[float]] = {}
    for r in celled.select("cell", "dist", place.alias("place")).where(F.col("place") <= k + 1).collect():
        nearest.setdefault(r["cell"], []).append(r["dist"])
    plan = make_plan(centres, data, asked, nearest, k, group_queries, block_rows)
    routed = "grp int, block bigint, id bigint, v array<bigint>"
    rows = celled.select("id", "v", "cell", "dist").mapInPandas(_router(plan), routed)
    queries = celled.where("asks").select("id", "v", "cell").mapInPandas(_asker(plan), routed)
    solved = (
        queries.groupBy("grp", "block")
        .cogroup(rows.groupBy("grp", "block"))
        .applyInPandas(lambda q, x: best_of_block(q, x, k, dims), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        solved.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    )


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    list_sum(list_transform(list_zip(q.c, x.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


@query("op1_voronoi_knn", SQL)
def voronoi_knn(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
