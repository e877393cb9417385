"""Operations on training corpora: search, cleaning, deduplication, mixing, tokens.

Nothing outside this package imports it.  `registry()` gives the queries over
the driver's tables and their SQL.
"""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = (
    "blob_ledger",
    "bucket_refinement",
    "coordinate_join",
    "count_tree",
    "forced_boundary",
    "hard_negatives",
    "mixing_tree",
    "rule_ledger",
    "surrogates",
    "token_counts",
    "toxicity",
    "voronoi_knn",
    "whitening",
)


def registry() -> SimpleNamespace:
    from lethe.llm import catalog

    for module in MODULES:
        importlib.import_module(f"lethe.llm.{module}")
    return SimpleNamespace(queries=catalog.QUERIES, checks=catalog.CHECKS)
