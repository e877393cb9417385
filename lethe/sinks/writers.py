"""Outputs of the library."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe import schemas
from lethe.sources.logs import load_run_logs
from lethe.sources.triples import base_name, list_files, scan_triples


def write_qa(accepted: DataFrame, missed: DataFrame, out_dir: str, fmt: str = "parquet") -> None:
    """Accepted rows and rejected rows with their reason.

    The missed table is written also when nothing was accepted.
    """
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    missed.select(*schemas.MISSED.names).write.mode("overwrite").options(**options).format(fmt).save(f"{out_dir}/missed")
    accepted.select(*schemas.QA.names).write.mode("overwrite").options(**options).format(fmt).save(f"{out_dir}/qa")


def checkpoint_by_source(df: DataFrame, path: str, source: str = "source") -> DataFrame:
    """Write sources not written before, one partition each; return all rows stored.

    Each source is replaced as a whole, so a run that was cut short can be
    repeated: finished sources are skipped by an anti-join on their names.
    """
    stored = load_run_logs(df.sparkSession, path, _with_last(df.schema, source))
    pending = df.join(stored.select(source).distinct(), source, "left_anti")
    columns = [c for c in df.columns if c != source] + [source]
    (
        pending.select(*columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(source)
        .parquet(path)
    )
    return df.sparkSession.read.schema(_with_last(df.schema, source)).parquet(path)


FINISHED = T.StructType([T.StructField("source", T.StringType())])


def checkpoint_files(
    spark: SparkSession,
    root: str,
    path: str,
    build: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    every: int = 100,
    unique: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Build and store the rows of all triple files below `root`; return all rows stored.

    A manifest of finished sources prunes the listing, so their files are not even
    opened.  The others are taken in the order of their paths, `every` sources at a
    time: `build` makes rows of `schema`, with a column `source`, from their triples,
    the rows are written, and then their names are added to the manifest.  A run
    that was cut short repeats one batch at most, and replaces what it had written
    of it.  Of rows that agree in one of the `unique` lists of columns the one of
    the earliest batch stays; within a batch that is up to `build`.
    """
    finished = load_run_logs(spark, f"{path}/finished", FINISHED)
    listed = list_files(spark, root).withColumn("source", base_name(F.col("path")))
    pending: dict[str, list[str]] = {}
    for row in listed.join(finished, "source", "left_anti").orderBy("path").collect():  # a scan needs its paths on the driver
        pending.setdefault(row["source"], []).append(row["path"])
    names = list(pending)
    stored_schema = _with_last(schema, "source")
    for at in range(0, len(names), every):
        batch = names[at : at + every]
        rows, _ = scan_triples(spark, [p for name in batch for p in pending[name]])
        made = build(rows)
        before = load_run_logs(spark, f"{path}/rows", stored_schema).where(~F.col("source").isin(*batch))
        for keys in unique:
            made = made.join(before.select(*keys).distinct(), list(keys), "left_anti")
        made.select(*stored_schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/rows")
        spark.createDataFrame([(name,) for name in batch], FINISHED).coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return load_run_logs(spark, f"{path}/rows", stored_schema)


def _with_last(schema: T.StructType, column: str) -> T.StructType:
    fields = [f for f in schema.fields if f.name != column]
    return T.StructType([*fields, schema[column]])


def write_metrics(df: DataFrame, path: str, keys: Sequence[str] = ("run", "metric")) -> None:
    """Store results so that a metric computed again replaces its old rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_metrics(df: DataFrame, path: str) -> None:
    """Results ordered by run and metric, as JSON lines."""
    ordered = df.orderBy("run", "metric")
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_sweep_csv(df: DataFrame, path: str) -> None:
    df.select(*schemas.SWEEP.names).write.mode("overwrite").option("header", True).csv(path)


def write_alternates(df: DataFrame, path: str, repeats: int = 5) -> None:
    """question, answer and alternate per line; one line for each of `repeats`."""
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    alternate = F.get(F.col("alternates"), F.col("repeat")) if "alternates" in df.columns else F.col("alternate")
    each.select("question", "answer", alternate.alias("alternate")).write.mode("overwrite").json(path)
