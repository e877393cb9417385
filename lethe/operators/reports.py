"""Names, sweeps and comparison tables of runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short trainer names, parsed trainers, the pattern of a run id
# (after the benchmark's prefix).
SHORT_TRAINER = {"GradAscent": "GA", "GradDiff": "GD", "NPO": "NPO"}
TRAINERS = ("GradAscent", "GradDiff", "NPO", "RMU")
RUN_ID = r"^%s_(.+)_(" + "|".join(TRAINERS) + r")_(.+)_lr_([0-9eE.+-]+)_(ft|orig)$"
TRAIN_LOSS = r"'train_loss':\s*([0-9]+(?:\.[0-9]+)?)"
LEARNING_RATES = (3e-5, 1e-5, 2e-4, 1e-4, 1e-3)


# ------------------------------------------------------------ names

def split_names(percent: Column, forget: Column) -> dict[str, Column]:
    p = percent.cast("string")
    return {
        "perturbed": F.concat(forget, F.lit("_perturbed")),
        "retain": F.concat(F.lit("retain_intersection"), (F.lit(100) - 2 * percent).cast("string")),
        "rare": F.concat(F.lit("rare_forget"), p),
        "popular": F.concat(F.lit("popular_forget"), p),
    }


def short_trainer(trainer: Column) -> Column:
    return reduce(lambda c, kv: c.when(trainer == kv[0], kv[1]), SHORT_TRAINER.items(), F.when(F.lit(False), "")).otherwise(trainer)


def path_safe(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def learning_rate_tag(lr: Column) -> Column:
    """Scientific notation without digits after the point, e.g. 3e-05."""
    return F.format_string("%.0e", lr)


def run_id(prefix: str, model: Column, trainer: Column, split: Column, lr: Column, base: Column) -> Column:
    return F.format_string(f"{prefix}_%s_%s_%s_lr_%s_%s", model, trainer, split, lr, base)


def parse_run_id(df: DataFrame, prefix: str, column: str = "run_id") -> DataFrame:
    """model, trainer, split, lr and base of a run id; all null where it does not parse."""
    pattern = RUN_ID % prefix
    ok = F.col(column).rlike(pattern)
    for i, name in enumerate(("model", "trainer", "split", "lr", "base"), start=1):
        df = df.withColumn(name, F.when(ok, F.regexp_extract(column, pattern, i)))
    return df


def unparsed(df: DataFrame) -> DataFrame:
    return df.where(F.col("trainer").isNull())


def train_loss(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TRAIN_LOSS, 1), F.lit("")).try_cast("double")


# ------------------------------------------------------------ tables

def sweep_table(runs: DataFrame, logs: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per run: run_id, learning_rate, train_loss, rouge.

    `runs` has run_id and learning_rate, `logs` run and value (console lines),
    `summaries` run and value (the metric).  A run without a summary is left out;
    one without a loss line has a null loss.
    """
    losses = logs.select(F.col("run").alias("run_id"), train_loss(F.col("value")).alias("l"))
    per_run = losses.groupBy("run_id").agg(F.max("l").alias("train_loss"))
    rouge = summaries.select(F.col("run").alias("run_id"), F.col("value").alias("rouge"))
    return (
        runs.join(per_run, "run_id", "left").join(rouge, "run_id").select("run_id", "learning_rate", "train_loss", "rouge")
    )


def method_split_matrix(df: DataFrame, columns: Sequence[tuple[str, str]], row: str = "method") -> DataFrame:
    """Rows are methods, columns split and metric pairs, all in one aggregate."""
    cells = [
        F.max(F.when((F.col("split") == s) & (F.col("metric") == m), F.col("agg_value"))).alias(f"{s}_{m}") for s, m in columns
    ]
    return df.groupBy(row).agg(*cells)


def compatible_splits(forget_split: Column, eval_split: Column) -> Column:
    """Rare runs are evaluated on rare or retain splits, popular on popular or retain."""
    on_retain = eval_split.contains("retain")
    return (
        F.when(forget_split.startswith("rare"), eval_split.contains("rare") | on_retain)
        .when(forget_split.startswith("popular"), eval_split.contains("popular") | on_retain)
        .otherwise(F.lit(True))
    )


def run_status(runs: DataFrame, results: DataFrame, done_before: DataFrame) -> DataFrame:
    """success, failed or skipped per run.

    `results` has run, exit_code and has_result per attempt, `done_before` the
    runs that were finished already.
    """
    attempts = results.groupBy("run").agg(
        F.bool_or((F.col("exit_code") == 0) & F.col("has_result")).alias("_ok")
    )
    skipped = done_before.select("run").distinct().withColumn("_skip", F.lit(True))
    status = F.when(F.col("_skip"), "skipped").when(F.col("_ok"), "success").otherwise("failed")
    return runs.join(attempts, "run", "left").join(skipped, "run", "left").select("run", status.alias("status"))


def base_deltas(df: DataFrame) -> DataFrame:
    """Each unlearned run's value minus that of its base model on the same split.

    Rows have base, split, run and agg_value; `run` is "base" for the base
    model.  The formula is this library's own: run minus base.
    """
    base = df.where(F.col("run") == "base").select("base", "split", F.col("agg_value").alias("base_value"))
    runs = df.where(F.col("run") != "base")
    return runs.join(base, ["base", "split"]).select(
        "base", "split", "run", "agg_value", "base_value", (F.col("agg_value") - F.col("base_value")).alias("delta")
    )


def split_sequence(df: DataFrame, prefix: str, split: str = "split") -> DataFrame:
    """Rows of the numbered splits `<prefix>_1`, `<prefix>_2`, ... with their step."""
    pattern = f"^{prefix}_(\\d+)$"
    return df.where(F.col(split).rlike(pattern)).withColumn("step", F.regexp_extract(split, pattern, 1).cast("int"))


def harness_summary(results: DataFrame, text: str = "value") -> DataFrame:
    """(run, key, number, raw) of harness results given as JSON per run and task.

    A row has run, task and the harness's JSON; a task that is a group takes its
    values from `groups`.  Aliases are dropped, text after a comma cut off.
    """
    kind = "struct<groups:map<string,map<string,string>>,results:map<string,map<string,string>>>"
    parsed = results.withColumn("_j", F.from_json(text, kind))
    of_group = F.try_element_at(F.col("_j.groups"), F.col("task"))
    values = F.coalesce(of_group, F.try_element_at(F.col("_j.results"), F.col("task")))
    each = parsed.select("run", "task", F.explode(values).alias("name", "raw")).where(F.col("name") != "alias")
    key = F.concat_ws("/", "task", F.trim(F.substring_index("name", ",", 1)))
    return each.select("run", key.alias("key"), F.col("raw").try_cast("double").alias("number"), "raw")
