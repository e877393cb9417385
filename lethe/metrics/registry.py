"""Metric functions by name.

A metric is a function of tables: `fn(inputs, **params) -> Result`.  `inputs`
holds the datasets it asked for under `data`, results of other metrics under
`pre_compute`, and those of a reference run under `reference`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Result:
    """Per-example rows, if any, and one row with `agg_value`.

    `agg` is that row, or a function from the per-example rows to it; the
    function is applied to the stored rows, so they are computed once.
    """

    agg: DataFrame | Callable[[DataFrame], DataFrame]
    values: DataFrame | None = None

    def aggregate(self) -> DataFrame:
        return self.agg(self.values) if callable(self.agg) else self.agg


@dataclass
class Inputs:
    data: dict[str, DataFrame] = field(default_factory=dict)
    pre_compute: dict[str, Result] = field(default_factory=dict)
    reference: dict[str, Result | None] = field(default_factory=dict)

    def only(self) -> DataFrame:
        (df,) = self.data.values()
        return df


Handler = Callable[..., Result]
METRICS: dict[str, Handler] = {}


@dataclass(frozen=True)
class TokenScores:
    """What a metric takes from each example's tokens, row by row.

    `fields` are the token fields it reads, `columns(**params)` the named
    expressions over packed tokens.  The runner computes those of a whole suite in
    one projection and hands the metric its columns in place of the tokens.
    """

    fields: tuple[str, ...]
    columns: Callable[..., dict[str, Any]]


TOKEN_SCORES: dict[str, TokenScores] = {}


def metric(name: str | None = None, tokens: TokenScores | None = None) -> Callable[[Handler], Handler]:
    """Register a metric function under a name (its own by default)."""

    def register(fn: Handler) -> Handler:
        METRICS[name or fn.__name__] = fn
        if tokens is not None:
            TOKEN_SCORES[name or fn.__name__] = tokens
        return fn

    return register


def get_metric(name: str) -> Handler:
    if name not in METRICS:
        raise NotImplementedError(f"metric {name!r} is not registered; known: {sorted(METRICS)}")
    return METRICS[name]


@dataclass(frozen=True)
class Spec:
    """How one named metric is computed.

    `data`: role -> (table, dataset); `parents`: name -> (spec, access key);
    `reference`: metric of the reference run -> access key.
    """

    handler: str
    data: dict[str, tuple[str, str]] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)
    reference: dict[str, str] = field(default_factory=dict)
