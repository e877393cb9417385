"""Run logs: metric results, summaries, console output and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lethe import schemas

RESULT_LINE = r"Result for metric (\S+):\t(.*)$"


def load_run_logs(spark: SparkSession, path: str, schema: T.StructType = schemas.METRIC_AGG) -> DataFrame:
    """Stored results, or an empty table of their schema where nothing is stored yet.

    Any other failure, such as a lack of rights, is raised.
    """
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(0).collect()
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_reference_logs(
    logs: DataFrame | None, run: str, include: dict[str, str] | DataFrame
) -> DataFrame | None:
    """Chosen metrics of a reference run under their access names.

    `include` maps metric to access name, as a dict or as a table (metric,
    access_key).  Without logs the step is skipped;
    an unknown run is an error; an absent metric is kept as null and flagged.
    """
    if logs is None:
        return None
    of_run = logs.where(F.col("run") == run)
    if not of_run.take(1):
        raise FileNotFoundError(f"no logs of run {run!r}")
    wanted = include
    if isinstance(include, dict):
        wanted = logs.sparkSession.createDataFrame(list(include.items()), "metric string, access_key string")
    return (
        wanted.join(of_run.select("metric", "agg_value", F.lit(True).alias("_found")), "metric", "left")
        .withColumn("missing", F.col("_found").isNull())
        .drop("_found")
    )


def metric_logs_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(run, metric, agg_value) from `*_EVAL.json` files, one object per file."""
    kind = T.MapType(T.StringType(), T.StructType([T.StructField("agg_value", T.DoubleType())]))
    return _per_run(spark, path, "*_EVAL.json", kind).select("run", "metric", F.col("value.agg_value").alias("agg_value"))


def metric_values_from_json(spark: SparkSession, path: str, pattern: str = "*_EVAL.json") -> DataFrame:
    """(run, metric, index, answer_idx, stat, value) from the per-example values of
    `*_EVAL.json` files: {metric: {"value_by_index": {index: {stat: number or list}}}}.

    A list has one row per answer, a number is answer 0; nulls and other kinds of
    value give a null.  Metrics without per-example values have no rows.
    """
    by_index = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    kind = T.MapType(T.StringType(), T.StructType([T.StructField("value_by_index", by_index)]))
    per_index = _per_run(spark, path, pattern, kind).select("run", "metric", F.explode("value.value_by_index").alias("index", "stats"))
    raw = per_index.select("run", "metric", F.col("index").cast("bigint").alias("index"), F.explode("stats").alias("stat", "raw"))
    listed = F.when(F.col("raw").startswith("["), F.from_json("raw", T.ArrayType(T.DoubleType()))).otherwise(F.array(F.col("raw").try_cast("double")))
    return raw.select("run", "metric", "index", "stat", F.posexplode(listed).alias("answer_idx", "value")).select(
        "run", "metric", "index", "answer_idx", "stat", "value"
    )


def reference_values(values: DataFrame, run: str, metric: str, stat: str = "score") -> DataFrame:
    """(index, answer_idx, `stat`) of one metric of a stored run: the table that
    metrics over a reference run take.  A run without it is an error."""
    found = values.where((F.col("run") == run) & (F.col("metric") == metric) & (F.col("stat") == stat))
    if found.isEmpty():
        raise FileNotFoundError(f"run {run!r} has no values {stat!r} of {metric!r}")
    return found.select("index", "answer_idx", F.col("value").alias(stat))


def load_summaries(
    spark: SparkSession, path: str, metric: str | None = None, pattern: str = "*_SUMMARY.json"
) -> DataFrame:
    """(run, metric, value) from `*_SUMMARY.json` files.

    With `metric` there is one row per run and a run without it is an error.
    """
    rows = _per_run(spark, path, pattern, schemas.RUN_SUMMARY)
    if metric is None:
        return rows
    picked = rows.groupBy("run").agg(F.max(F.when(F.col("metric") == metric, F.col("value"))).alias("value"))
    missing = F.raise_error(F.concat(F.lit(f"no {metric} in the summary of "), F.col("run"))).cast("double")
    return picked.select("run", F.lit(metric).alias("metric"), F.coalesce("value", missing).alias("value"))


def _per_run(spark: SparkSession, path: str, pattern: str, kind: T.MapType) -> DataFrame:
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter=pattern, wholetext=True).text(path)
    parsed = files.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"),
        F.explode(F.from_json("value", kind)).alias("metric", "value"),
    )
    return parsed


def result_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Metric name and value of result lines; `value` is null unless a number."""
    found = lines.where(F.col(text).rlike(RESULT_LINE)).withColumn(
        "metric", F.regexp_extract(text, RESULT_LINE, 1)
    )
    raw = F.trim(F.regexp_extract(text, RESULT_LINE, 2))
    return found.withColumn("agg_value", raw.try_cast("double")).withColumn("raw", raw)


def run_status(lines: DataFrame, run: str = "run", text: str = "value", exit_code: Column | None = None) -> DataFrame:
    """success when a run ended well and printed a result, else failed."""
    printed = F.bool_or(F.coalesce(F.col(text).rlike(RESULT_LINE), F.lit(False)))
    ended = F.max(exit_code) == 0 if exit_code is not None else F.lit(True)
    return lines.groupBy(run).agg(F.when(printed & ended, "success").otherwise("failed").alias("status"))


def latest_checkpoint(paths: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """The checkpoint with the greatest number, per run."""
    number = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1).try_cast("long")
    numbered = paths.withColumn("_step", number).where(F.col("_step").isNotNull())
    return numbered.groupBy(run).agg(F.max_by(path, "_step").alias(path), F.max("_step").alias("step"))


def list_checkpoints(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(run, path) of checkpoint folders, from the names of the files in them."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
    folder = F.regexp_extract("path", r"^(.*/checkpoint-\d+)/", 1)
    found = files.select(folder.alias("path")).where(F.col("path") != "").distinct()
    return found.select(F.element_at(F.split("path", "/"), -2).alias("run"), "path")


def scan_eval_logs(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """Lines of console logs with the run they belong to (the folder's name)."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=pattern).text(root)
    return lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), "value")
