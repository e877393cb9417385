"""Evaluation files of a reference run."""

from lethe.plans.scoring import write_reference
from lethe.session import scratch_path
from lethe.sources.logs import metric_values_from_json, reference_values


def test_a_run_is_written_in_files_of_bounded_size(spark):
    root = scratch_path(spark, "reference-test")
    scores = spark.range(250).selectExpr("id AS index", "id / 7 AS score")
    write_reference(scores, f"{root}/retain", 100)
    files = spark.read.text(f"{root}/retain", wholetext=True).collect()
    assert len(files) == 3 and all(f.value.count('"score"') <= 100 and f.value.strip().count("\n") == 0 for f in files)
    values = reference_values(metric_values_from_json(spark, root, "part-*"), "retain", "forget_truth_ratio")
    assert {(r["index"], r.score) for r in values.collect()} == {(i, i / 7) for i in range(250)}
