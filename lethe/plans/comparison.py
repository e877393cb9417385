"""Queries: sweeps and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe import schemas
from lethe.operators import reports as RP
from lethe.plans.catalog import query
from lethe.plans.inputs import table
from lethe.session import scratch_path
from lethe.sinks.writers import write_sweep_csv
from lethe.sources.logs import latest_checkpoint, load_summaries, result_lines, run_status, scan_eval_logs

# ------------------------------------------------------------ derived inputs


def console_logs(spark: SparkSession, sf: str) -> str:
    """Text logs, one folder per user and type: result lines, loss lines, noise."""
    path = scratch_path(spark, "console")
    events = table(spark, sf, "events")
    kind, value = F.col("event_type"), F.col("value").cast("decimal(12,2)").cast("string")
    line = (
        F.when(kind == "purchase", F.concat(F.lit("Result for metric forget_ROUGE:\t"), value))
        .when(kind == "signup", F.concat(F.lit("Result for metric status:\tnan?"), F.col("user_id").cast("string")))
        .when(kind == "view", F.concat(F.lit("{'train_loss': "), value, F.lit("}")))
        .otherwise(F.concat(kind, F.lit(" "), value))
    )
    run = F.concat(F.lit("run"), (F.col("user_id") % 40).cast("string"))
    events.select(line.alias("value"), run.alias("run")).write.partitionBy("run").text(path)
    return path


LINES_SQL = """
lines AS (
  SELECT 'run' || (user_id % 40) AS run, event_type, event_id, value, value::DECIMAL(12,2)::VARCHAR AS txt, user_id FROM events)"""


def folder_run(df: DataFrame) -> DataFrame:
    return df.withColumn("run", F.regexp_replace("run", "^run=", ""))


def sweep_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per order customer: model, trainer, split, learning rate and base by key."""
    k = F.col("c_custkey")

    def pick(*names: str):
        return F.get(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int"))

    model = F.concat(pick("Llama-3.1", "gemma", "phi_3"), F.lit("-"), k.cast("string"))
    return table(spark, sf, "customer").select(
        k.alias("c_custkey"),
        RP.run_id(
            "facts", model, pick("GradAscent", "GradDiff", "NPO", "RMU", "Other"), pick("rare_forget10", "popular_forget5"),
            pick("1e-5", "3e-05", "0.0002"), pick("ft", "orig"),
        ).alias("run_id"),
        F.col("c_acctbal"),
    )


RUNS_SQL = """
runs AS (
  SELECT c_custkey, c_acctbal,
    ['Llama-3.1', 'gemma', 'phi_3'][c_custkey % 3 + 1] || '-' || c_custkey AS model,
    ['GradAscent', 'GradDiff', 'NPO', 'RMU', 'Other'][c_custkey % 5 + 1] AS trainer,
    ['rare_forget10', 'popular_forget5'][c_custkey % 2 + 1] AS split,
    ['1e-5', '3e-05', '0.0002'][c_custkey % 3 + 1] AS lr,
    ['ft', 'orig'][c_custkey % 2 + 1] AS base
  FROM customer)"""


# ------------------------------------------------------------ queries


@query(
    "src8_scan_eval_text_logs",
    f"""WITH {LINES_SQL}
SELECT run, 'forget_ROUGE' AS metric, txt::DOUBLE AS agg_value FROM lines WHERE event_type = 'purchase'
UNION ALL SELECT run, 'status', NULL FROM lines WHERE event_type = 'signup'""",
)
def src8(spark: SparkSession, sf: str) -> DataFrame:
    lines = folder_run(scan_eval_logs(spark, console_logs(spark, sf)))
    return result_lines(lines).select("run", "metric", "agg_value")


@query(
    "src9_latest_checkpoint",
    "SELECT 'cust' || o_custkey AS run, 'cust' || o_custkey || '/checkpoint-' || max(o_orderkey) AS path, max(o_orderkey) AS step FROM orders GROUP BY o_custkey",
)
def src9(spark: SparkSession, sf: str) -> DataFrame:
    run = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))
    paths = table(spark, sf, "orders").select(
        run.alias("run"), F.concat(run, F.lit("/checkpoint-"), F.col("o_orderkey").cast("string")).alias("path")
    )
    return latest_checkpoint(paths)


@query(
    "srt2_version_sort_latest",
    "SELECT 'p' || p_size AS run, max(p_partkey) AS step FROM part GROUP BY p_size",
)
def srt2(spark: SparkSession, sf: str) -> DataFrame:
    run = F.concat(F.lit("p"), F.col("p_size").cast("string"))
    paths = table(spark, sf, "part").select(
        run.alias("run"), F.concat(F.lit("saves/checkpoint-"), F.col("p_partkey").cast("string"), F.lit("/")).alias("path")
    ).unionByName(table(spark, sf, "part").select(run.alias("run"), F.lit("saves/final").alias("path")))
    return latest_checkpoint(paths).select("run", "step")


@query("src10_load_summaries", "SELECT event_type AS run, 'm7' AS metric, round(avg(value), 6) AS value FROM events WHERE user_id % 50 = 7 GROUP BY event_type")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    from lethe.plans.evaluation import metric_log

    path = scratch_path(spark, "summaries")
    log = metric_log(spark, sf)
    per_run = log.groupBy("run").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "agg_value")))).alias("value"))
    per_run.repartition("run").write.partitionBy("run").text(path)
    return folder_run(load_summaries(spark, path, "m7", pattern="*.txt"))


@query(
    "prj1_split_names",
    """SELECT c_custkey, 'forget' || p AS base, 'forget' || p || '_perturbed' AS perturbed, 'retain_intersection' || (100 - 2 * p) AS retain,
  'rare_forget' || p AS rare, 'popular_forget' || p AS popular FROM (SELECT c_custkey, [1, 5, 10][c_custkey % 3 + 1] AS p FROM customer)""",
)
def prj1(spark: SparkSession, sf: str) -> DataFrame:
    p = F.get(F.array(F.lit(1), F.lit(5), F.lit(10)), (F.col("c_custkey") % 3).cast("int"))
    base = F.concat(F.lit("forget"), p.cast("string"))
    names = RP.split_names(p, base)
    return table(spark, sf, "customer").select("c_custkey", base.alias("base"), *[c.alias(n) for n, c in names.items()])


@query(
    "prj2_run_id_format",
    f"""WITH {RUNS_SQL}
SELECT c_custkey, 'facts_' || model || '_' || trainer || '_' || split || '_lr_' || lr || '_' || base AS run_id,
  CASE trainer WHEN 'GradAscent' THEN 'GA' WHEN 'GradDiff' THEN 'GD' ELSE trainer END AS abbr,
  replace(replace('org/' || model || ' x', '/', '__'), ' ', '_') AS tag FROM runs""",
)
def prj2(spark: SparkSession, sf: str) -> DataFrame:
    parsed = RP.parse_run_id(sweep_runs(spark, sf), "facts")
    k = F.col("c_custkey")
    trainer = F.coalesce("trainer", F.lit("Other"))
    model = F.concat(F.get(F.array(F.lit("Llama-3.1"), F.lit("gemma"), F.lit("phi_3")), (k % 3).cast("int")), F.lit("-"), k.cast("string"))
    tag = RP.path_safe(F.concat(F.lit("org/"), model, F.lit(" x")))
    return parsed.select("c_custkey", "run_id", RP.short_trainer(trainer).alias("abbr"), tag.alias("tag"))


@query(
    "prj3_parse_run_id",
    f"""WITH {RUNS_SQL}
SELECT c_custkey, CASE WHEN trainer <> 'Other' THEN model END AS model, nullif(trainer, 'Other') AS trainer,
  CASE WHEN trainer <> 'Other' THEN split END AS split, CASE WHEN trainer <> 'Other' THEN lr END AS lr,
  CASE WHEN trainer <> 'Other' THEN base END AS base FROM runs""",
)
def prj3(spark: SparkSession, sf: str) -> DataFrame:
    return RP.parse_run_id(sweep_runs(spark, sf), "facts").select("c_custkey", "model", "trainer", "split", "lr", "base")


@query(
    "prj4_extract_train_loss",
    f"WITH {LINES_SQL} SELECT run, CASE WHEN event_type = 'view' THEN txt::DOUBLE END AS train_loss, count(*) AS n FROM lines GROUP BY ALL",
)
def prj4(spark: SparkSession, sf: str) -> DataFrame:
    lines = folder_run(scan_eval_logs(spark, console_logs(spark, sf)))
    return lines.groupBy("run", RP.train_loss(F.col("value")).alias("train_loss")).agg(F.count("*").alias("n"))


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are customers' folders 0-39; the summary is each run's mean purchase."""
    lines = folder_run(scan_eval_logs(spark, console_logs(spark, sf)))
    rates = F.array(*[F.lit(r) for r in RP.LEARNING_RATES])
    number = F.regexp_extract("run", r"(\d+)$", 1).cast("int")
    runs = lines.select("run").distinct().select(
        F.col("run").alias("run_id"), F.get(rates, number % len(RP.LEARNING_RATES)).alias("learning_rate")
    )
    scores = result_lines(lines).where("metric = 'forget_ROUGE'").groupBy("run").agg(F.max("agg_value").alias("value"))
    return RP.sweep_table(runs, lines, scores)


_SWEEP_SQL = f"""WITH {LINES_SQL}
SELECT run AS run_id, [3e-5::DOUBLE, 1e-5::DOUBLE, 2e-4::DOUBLE, 1e-4::DOUBLE, 1e-3::DOUBLE][substr(run, 4)::INT % 5 + 1] AS learning_rate,
  max(CASE WHEN event_type = 'view' THEN txt::DOUBLE END) AS train_loss, max(CASE WHEN event_type = 'purchase' THEN txt::DOUBLE END) AS rouge
FROM lines GROUP BY run HAVING rouge IS NOT NULL"""


@query("rpt1_sweep_table", _SWEEP_SQL)
def rpt1(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf)


@query("snk4_write_sweep_csv", _SWEEP_SQL)
def snk4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sweep")
    write_sweep_csv(_sweep(spark, sf), path)
    return spark.read.schema(schemas.SWEEP).option("header", True).csv(path)


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """(method, split, metric, agg_value) from events."""
    k = F.col("user_id")
    split = F.get(F.array(F.lit("forget01"), F.lit("forget05"), F.lit("forget10")), (k % 3).cast("int"))
    name = F.when(k % 2 == 0, "forget_quality").otherwise("model_utility")
    events = table(spark, sf, "events")
    return events.groupBy(F.col("event_type").alias("method"), split.alias("split"), name.alias("metric")).agg(
        F.round(F.avg("value"), 6).alias("agg_value")
    )


BOARD_SQL = """
board AS (
  SELECT event_type AS method, ['forget01', 'forget05', 'forget10'][user_id % 3 + 1] AS split,
    CASE WHEN user_id % 2 = 0 THEN 'forget_quality' ELSE 'model_utility' END AS metric, round(avg(value), 6) AS agg_value
  FROM events GROUP BY ALL)"""
CELLS = [(s, m) for s in ("forget01", "forget05", "forget10") for m in ("forget_quality", "model_utility")]


@query(
    "rpt2_method_split_matrix",
    f"WITH {BOARD_SQL} SELECT method, "
    + ", ".join(f"max(agg_value) FILTER (split = '{s}' AND metric = '{m}') AS {s}_{m}" for s, m in CELLS)
    + " FROM board GROUP BY method",
)
def rpt2(spark: SparkSession, sf: str) -> DataFrame:
    return RP.method_split_matrix(leaderboard(spark, sf), CELLS)


@query(
    "rpt3_eval_split_compat",
    """WITH s(e) AS (VALUES ('rare_forget10'), ('popular_forget5'), ('retain_intersection80'))
SELECT c_custkey, e AS eval_split FROM (SELECT c_custkey, ['rare_forget10', 'popular_forget5', 'full'][c_custkey % 3 + 1] AS f FROM customer), s
WHERE CASE WHEN f LIKE 'rare%' THEN e LIKE '%rare%' OR e LIKE '%retain%' WHEN f LIKE 'popular%' THEN e LIKE '%popular%' OR e LIKE '%retain%' ELSE true END""",
)
def rpt3(spark: SparkSession, sf: str) -> DataFrame:
    forget = F.get(F.array(F.lit("rare_forget10"), F.lit("popular_forget5"), F.lit("full")), (F.col("c_custkey") % 3).cast("int"))
    splits = F.array(F.lit("rare_forget10"), F.lit("popular_forget5"), F.lit("retain_intersection80"))
    each = table(spark, sf, "customer").select("c_custkey", forget.alias("f"), F.explode(splits).alias("eval_split"))
    return each.where(RP.compatible_splits(F.col("f"), F.col("eval_split"))).select("c_custkey", "eval_split")


@query(
    "rpt4_run_status",
    """WITH a AS (SELECT o_custkey, bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS ok FROM orders GROUP BY o_custkey)
SELECT 'c' || c_custkey AS run, CASE WHEN c_mktsegment = 'BUILDING' THEN 'skipped' WHEN ok THEN 'success' ELSE 'failed' END AS status
FROM customer LEFT JOIN a ON o_custkey = c_custkey""",
)
def rpt4(spark: SparkSession, sf: str) -> DataFrame:
    def run(key: str):
        return F.concat(F.lit("c"), F.col(key).cast("string")).alias("run")

    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    attempts = orders.select(
        run("o_custkey"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("exit_code"),
        (F.col("o_orderpriority") == "1-URGENT").alias("has_result"),
    )
    return RP.run_status(customer.select(run("c_custkey")), attempts, customer.where("c_mktsegment = 'BUILDING'").select(run("c_custkey")))


@query(
    "rpt4_log_status",
    f"WITH {LINES_SQL} SELECT run, CASE WHEN bool_or(event_type IN ('purchase', 'signup')) THEN 'success' ELSE 'failed' END AS status FROM lines GROUP BY run",
)
def rpt4_logs(spark: SparkSession, sf: str) -> DataFrame:
    return run_status(folder_run(scan_eval_logs(spark, console_logs(spark, sf))))


@query(
    "rpt5_base_vs_unlearned_delta",
    """WITH v AS (SELECT ['ft', 'orig'][user_id % 2 + 1] AS base, ['rare', 'popular', 'retain'][user_id % 3 + 1] AS split,
  CASE WHEN event_type = 'view' THEN 'base' ELSE event_type END AS run, round(avg(value), 6) AS agg_value FROM events GROUP BY ALL)
SELECT r.base, r.split, r.run, round(r.agg_value - b.agg_value, 6) AS delta FROM v r JOIN v b USING (base, split) WHERE r.run <> 'base' AND b.run = 'base'""",
)
def rpt5(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("user_id")
    rows = table(spark, sf, "events").groupBy(
        F.get(F.array(F.lit("ft"), F.lit("orig")), (k % 2).cast("int")).alias("base"),
        F.get(F.array(F.lit("rare"), F.lit("popular"), F.lit("retain")), (k % 3).cast("int")).alias("split"),
        F.when(F.col("event_type") == "view", "base").otherwise(F.col("event_type")).alias("run"),
    ).agg(F.round(F.avg("value"), 6).alias("agg_value"))
    return RP.base_deltas(rows).select("base", "split", "run", F.round("delta", 6).alias("delta"))


@query(
    "rpt7_subset_splits",
    "SELECT (user_id % 4 + 1)::INTEGER AS step, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
)
def rpt7(spark: SparkSession, sf: str) -> DataFrame:
    split = F.concat(F.lit("forget_"), (F.col("user_id") % 4 + 1).cast("string"))
    rows = table(spark, sf, "events").withColumn("split", split)
    steps = RP.split_sequence(rows, "forget")
    return steps.groupBy("step").agg(F.count("*").alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value"))
