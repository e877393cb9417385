"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.10g}"  # -0 equals 0
    return str(v)


def _kind(arrow_type) -> str:
    t = str(arrow_type)
    return {"large_string": "string"}.get(t, t)


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    kinds = [_kind(table.schema.field(n).type) for n in names]
    return names, kinds, sorted(tuple(_cell(v) for v in row) for row in zip(*cols)) if names else []


def compare(spark_df, sql: str, sf_dir: str) -> list[str]:
    """Differences between the two sides; empty when they agree."""
    got = rows_of(spark_df.toArrow())
    want = rows_of(duck(sf_dir).sql(sql).to_arrow_table())
    problems = []
    if got[0] != want[0]:
        return [f"columns {got[0]} vs {want[0]}"]
    if got[1] != want[1]:
        problems.append(f"types {list(zip(got[0], got[1], want[1]))}")
    if len(got[2]) != len(want[2]):
        problems.append(f"rows {len(got[2])} vs {len(want[2])}")
    different = [(a, b) for a, b in zip(got[2], want[2]) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems
