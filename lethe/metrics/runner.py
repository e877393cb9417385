"""Evaluation of a suite: parents first, each result stored once and reused."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lethe import schemas
from lethe.metrics import handlers  # noqa: F401  (registers the built-in metrics)
from lethe.metrics.registry import TOKEN_SCORES, Inputs, Result, Spec, get_metric
from lethe.operators.aggregates import losses_from_tokens, pack_tokens
from lethe.session import materialise
from lethe.sources.logs import load_run_logs

log = logging.getLogger("lethe.metrics")


@dataclass
class MetricStore:
    """Results of runs below one folder: `agg` by run and metric, and one table of
    per-example values for each."""

    spark: SparkSession
    path: str

    def _place(self, kind: str, run: str, name: str) -> str:
        return f"{self.path}/{kind}/run={run}/metric={name}"

    def aggregates(self) -> DataFrame:
        return load_run_logs(self.spark, f"{self.path}/agg")

    def done(self, run: str) -> set[str]:
        """Names of the run's stored metrics, as many as a suite has."""
        rows = self.aggregates().where(F.col("run") == run).select("metric").distinct()
        return {r["metric"] for r in rows.collect()}

    def write(self, run: str, name: str, result: Result) -> Result:
        stored = result
        if result.values is not None:
            place = self._place("values", run, name)
            result.values.write.mode("overwrite").parquet(place)
            stored = Result(result.agg, self.spark.read.schema(result.values.schema).parquet(place))
        agg = stored.aggregate().select(F.col("agg_value").cast("double"))
        agg.coalesce(1).write.mode("overwrite").parquet(self._place("agg", run, name))
        return Result(self._agg(run, name), stored.values)

    def _agg(self, run: str, name: str) -> DataFrame:
        return self.spark.read.schema("agg_value double").parquet(self._place("agg", run, name))

    def read(self, run: str, name: str, with_values: bool = True) -> Result:
        values = None
        if with_values:
            try:
                values = self.spark.read.parquet(self._place("values", run, name))
            except AnalysisException as e:  # a metric without per-example values has no such folder
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return Result(self._agg(run, name), values)


def pending_metrics(requested: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Requested (run, metric) without a stored value."""
    if overwrite:
        return requested
    return requested.join(done.where(F.col("agg_value").isNotNull()), ["run", "metric"], "left_anti")


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results by run and metric; a new one replaces the old."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    newest = both.groupBy("run", "metric").agg(F.max(F.struct("_age", "agg_value")).alias("_r"))
    return newest.select("run", "metric", F.col("_r.agg_value").alias("agg_value"))


def summarize(results: DataFrame, suite: tuple[str, ...] | list[str]) -> DataFrame:
    """Values of the suite's metrics, without nulls."""
    return results.where(F.col("agg_value").isNotNull() & F.col("metric").isin(*suite))


def _needed(specs: Mapping[str, Spec], suite: tuple[str, ...] | list[str], known: set[str]) -> dict[str, Spec]:
    """The metrics of a suite, and those they rest on, that are not stored yet."""
    found: dict[str, Spec] = {}
    waiting = list(suite)
    while waiting:
        name = waiting.pop()
        if name not in known and name not in found:
            found[name] = specs[name]
            waiting += [source for source, _ in specs[name].parents.values()]
    return found


def _column(spec: Spec, name: str) -> str:
    return f"{spec.handler}({', '.join(f'{k}={v}' for k, v in sorted(spec.params.items()))}) {name}".replace(".", "_")


def fuse_token_scores(needed: Mapping[str, Spec], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Table -> stored scores (dataset, index, answer_idx, one column per score).

    Every metric that works on an example's tokens alone becomes a column of one
    projection over its table, computed for the datasets that ask for it: the tokens
    of a suite are read and brought together once, whatever the number of metrics,
    and only scores are kept.  Tokens of datasets that want sums alone are added up
    where they are, for all tables in one grouping; only the others are packed, or
    read from a table `<name>_packed` that holds the same examples packed already.
    """
    wanted: dict[str, dict[str, set[str]]] = {}  # table -> column -> datasets
    made: dict[str, tuple[str, Column]] = {}
    fields: dict[str, dict[str, set[str]]] = {}  # table -> dataset -> token fields
    for spec in needed.values():
        scores = TOKEN_SCORES.get(spec.handler)
        for table, dataset in spec.data.values() if scores else ():
            fields.setdefault(table, {}).setdefault(dataset, set()).update(scores.fields)
            for name, expression in scores.columns(**spec.params).items():
                made[_column(spec, name)] = (name, expression)
                wanted.setdefault(table, {}).setdefault(_column(spec, name), set()).add(dataset)
    keys = ["dataset", *handlers.EXAMPLE]
    fused: dict[str, DataFrame] = {}
    sums: dict[str, DataFrame] = {}
    for table, read in fields.items():
        rows, columns = tables[table], wanted[table]
        whole = set(read)
        if handlers.TOK not in rows.columns:
            whole = {d for c, datasets in columns.items() if made[c][0] not in ("avg_loss", "prob") for d in datasets}
            added = set(read) - whole
            if added:
                sums[table] = rows.where(_is_one_of(added)).select(F.lit(table).alias("_table"), *keys, *handlers.LOSS_FIELDS)
        if whole:
            packed = tables.get(f"{table}_packed", rows).where(_is_one_of(whole))
            if handlers.TOK not in packed.columns:
                used = sorted(set().union(*(read[d] for d in whole)))
                packed = pack_tokens(packed.select(*keys, "pos", *used), keys)
            each = [F.when(_is_one_of(datasets & whole), made[c][1]).alias(c) for c, datasets in columns.items() if datasets & whole]
            fused[table] = materialise(packed.select(*keys, *each), "token-scores")
    if sums:
        losses = materialise(losses_from_tokens(reduce(DataFrame.unionByName, sums.values()), ["_table", *keys]), "token-losses")
        for table in sums:
            named = [F.col(made[c][0]).alias(c) for c in wanted[table] if made[c][0] in ("avg_loss", "prob")]
            own = losses.where(F.col("_table") == table).select(*keys, *named)
            fused[table] = fused[table].unionByName(own, allowMissingColumns=True) if table in fused else own
    return fused


def _is_one_of(datasets: set[str]) -> Column:
    return F.col("dataset").isin(*sorted(datasets))


def _datasets(spec: Spec, tables: Mapping[str, DataFrame], fused: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each dataset; `dataset` is a partition column of stored tables."""
    found = {}
    for role, (table, dataset) in spec.data.items():
        scores = TOKEN_SCORES.get(spec.handler)
        if scores and table in fused:
            names = [F.col(f"`{_column(spec, n)}`").alias(n) for n in scores.columns(**spec.params)]
            found[role] = fused[table].where(F.col("dataset") == dataset).select(*handlers.EXAMPLE, *names)
        else:
            found[role] = tables[table].where(F.col("dataset") == dataset).drop("dataset")
    return found


def evaluate(
    store: MetricStore,
    run: str,
    specs: Mapping[str, Spec],
    suite: tuple[str, ...] | list[str],
    tables: Mapping[str, DataFrame],
    reference_run: str | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Run the metrics of a suite that are not stored yet; return its summary.

    A shared parent is computed once, and tokens are read once for all metrics that
    score examples by them.  Every result is stored before the next
    is begun, so a run that was cut short goes on where it stopped.
    """
    known = store.done(run) if not overwrite else set()
    reference_known = store.done(reference_run) if reference_run else set()
    if reference_run and not reference_known:
        raise FileNotFoundError(f"no logs of run {reference_run!r}")
    cache: dict[str, Result] = {}
    fused = fuse_token_scores(_needed(specs, suite, known), tables)

    def resolve(name: str, spec: Spec) -> Result:
        if name not in cache:
            if name in known:
                log.info("skipping %s, already evaluated", name)
                cache[name] = store.read(run, name)
            else:
                cache[name] = store.write(run, name, get_metric(spec.handler)(inputs_of(spec), **spec.params))
        return cache[name]

    def inputs_of(spec: Spec) -> Inputs:
        parents = {key: resolve(name, specs[source]) for name, (source, key) in spec.parents.items()}
        reference: dict[str, Result | None] = {}
        for name, key in (spec.reference if reference_run else {}).items():
            if name not in reference_known:
                log.warning("%s is not in the logs of %s", name, reference_run)
                reference[key] = None
            else:
                reference[key] = store.read(reference_run, name)
        return Inputs(_datasets(spec, tables, fused), parents, reference)

    for name in suite:
        resolve(name, specs[name])
    own = store.aggregates().where(F.col("run") == run)
    return summarize(own, suite).select(*schemas.METRIC_AGG.names)
