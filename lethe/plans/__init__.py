"""Queries over the driver's tables, one module per stage."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

STAGES = ("construction", "preparation", "scoring", "evaluation", "comparison")


def registry() -> SimpleNamespace:
    from lethe.plans import catalog

    for stage in STAGES:
        importlib.import_module(f"lethe.plans.{stage}")
    return SimpleNamespace(queries=catalog.QUERIES, checks=catalog.CHECKS)
