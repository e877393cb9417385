"""Dataset splits, corpora, response pools and few-shot examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe import schemas
from lethe.functions.text import strip
from lethe.operators.order import index_by_place, placed


def load_split(
    spark: SparkSession, path: str, name: str | None = None, split: str | None = None, data_files: str | Sequence[str] | None = None
) -> DataFrame:
    """Rows of one configuration and split.

    A table partitioned by `config` and `split` is pruned to their folders;
    `data_files` names files below `path` instead.
    """
    if path == "text":
        return spark.read.text(data_files if isinstance(data_files, str) else list(data_files))
    if data_files is not None:
        files = [data_files] if isinstance(data_files, str) else list(data_files)
        return spark.read.parquet(*[f"{path}/{f}" for f in files])
    df = spark.read.parquet(path)
    for column, wanted in (("config", name), ("split", split)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def load_text_lines(
    spark: SparkSession, path: str | Sequence[str], parse_json: bool = False, text_key: str = "text", index: str | None = None
) -> DataFrame:
    """One record per line in the column `text`.

    JSON-lines files come as raw lines unless `parse_json` takes their text field.
    `index` names a further column for the dense position of the line; files of any
    size are still read in blocks, and files follow each other in the order of
    their paths.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    text = F.get_json_object("value", f"$.{text_key}") if parse_json else F.col("value")
    if index is None:
        return lines.select(text.alias("text"))
    return index_by_place(placed(lines, text.alias("text")), index)


def load_response_pool(spark: SparkSession, path: str) -> DataFrame:
    """Stripped responses, one per line, and their dense `index` in file order."""
    return index_by_place(placed(spark.read.text(path), strip(F.col("value")).alias("response")))


def load_examples(spark: SparkSession, path: str, n_shot: int | None = None) -> DataFrame:
    """The first `n_shot` examples of a JSON array, in file order.

    The file is one array, so one task reads it; `position` is its order.  A folder
    of several files has no one order and is an error.
    """
    examples = spark.read.schema(schemas.FEW_SHOT).option("multiLine", True).json(path)
    if len(examples.inputFiles()) > 1:
        raise ValueError(f"{path} holds several files of examples")
    placed = examples.withColumn("position", F.monotonically_increasing_id())
    return placed if n_shot is None else placed.where(F.col("position") < n_shot)
