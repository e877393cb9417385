import math

import pytest
from pyspark.sql import functions as F

from lethe import schemas
from lethe.metrics import runner as M
from lethe.metrics.registry import METRICS, Inputs, Result, Spec, get_metric, metric
from lethe.metrics.specs import MIA_PARAMS, SPECS, SUITES
from lethe.operators import aggregates as A
from lethe.operators import reports as RP
from lethe.sources import logs as L


def test_every_spec_is_complete():
    assert {n: len(s) for n, s in SPECS.items()} == {"tofu": 34, "muse": 13, "facts": 2}
    for name, specs in SPECS.items():
        for spec in specs.values():
            assert spec.handler in METRICS
            assert all(source in specs for source, _ in spec.parents.values())
        assert set(SUITES[name]) <= set(specs)
    builtin = {"probability", "probability_w_options", "rouge", "truth_ratio", "exact_memorization", "extraction_strength",
               "ks_test", "privleak", "rel_diff", "hm_aggregate", "classifier_prob", *MIA_PARAMS}
    assert builtin <= set(METRICS) and len(builtin) == 17
    with pytest.raises(NotImplementedError):
        get_metric("nope")


def token_table(spark, shift=0):
    sets = {spec for s in (SPECS["tofu"],) for m in s.values() for t, spec in m.data.values() if t == "tokens"}
    rows = []
    for dataset in sorted(sets):
        for index in range(12):
            for answer in range(3 if dataset.endswith("pert") else 1):
                for pos in range(10):
                    word = f"w{(index + pos) % 5}"
                    label = -100 if pos < 3 else pos
                    lp = -float((index * 31 + pos * 17 + answer * 7 + shift + len(dataset)) % 97 + 1) / 32
                    rows.append((dataset, index, answer, pos, label, lp, label + (index + pos + shift) % 2, -2.0, 0.5, word))
    return spark.createDataFrame(
        rows, "dataset string, index long, answer_idx int, pos int, label_id int, logprob double, pred_id int, mu double, sigma2 double, word string"
    )


def tables(spark, shift=0):
    texts = [("TOFU_QA_" + d, i, 0, "q", "the cat sat down", f"the cat {'sat' if i % 2 else 'ran'}") for d in
             ("forget", "forget_para", "forget_pert", "retain_eval", "ra", "wf") for i in range(12)]
    norms = [(d, i, p, float(i + len(p)), 2.0) for d in ("TOFU_QA_forget", "TOFU_QA_holdout") for i in range(12) for p in ("w", "bias")]
    logits = [("forget_Q_A_ROUGE", i, 0, [1.0, float(i)]) for i in range(12)]
    return {
        "tokens": token_table(spark, shift),
        "reference_tokens": token_table(spark, 50),
        "generations": spark.createDataFrame(texts, "dataset string, index long, answer_idx int, input string, ground_truth string, generation string"),
        "grad_norms": spark.createDataFrame(norms, "dataset string, index long, param string, norm double, p double"),
        "logits": spark.createDataFrame(logits, "dataset string, index long, answer_idx int, logits array<double>"),
    }


def test_every_metric_runs_from_rows_and_from_packed_tokens(spark, tmp_path):
    specs = SPECS["tofu"]
    by_layout = {}
    for layout in ("rows", "packed"):
        given = tables(spark)
        if layout == "packed":
            for name in ("tokens", "reference_tokens"):
                given[name] = A.pack_tokens(given[name], ["dataset", "index", "answer_idx"])
        store = M.MetricStore(spark, str(tmp_path / layout))
        M.evaluate(store, "retain", specs, ("forget_quality", "privleak"), {**given, "tokens": given["reference_tokens"]})
        done = M.evaluate(store, "target", specs, tuple(specs), given, reference_run="retain")
        by_layout[layout] = {r["metric"]: r["agg_value"] for r in done.collect()}
    assert set(by_layout["rows"]) == set(specs)
    for name, value in by_layout["rows"].items():
        assert value == pytest.approx(by_layout["packed"][name], rel=1e-9), name
    assert 0 <= by_layout["rows"]["forget_quality"] <= 1
    assert by_layout["rows"]["forget_Q_A_ROUGE"] == pytest.approx((2 / 4 + 3 / 4) / 2)


def test_a_suite_brings_tokens_together_once(spark, tmp_path, monkeypatch):
    packed, summed = [], []
    real_pack, real_sum = A.pack_tokens, A.losses_from_tokens
    for module in (M, A):
        monkeypatch.setattr(module, "pack_tokens", lambda *a: (packed.append(1), real_pack(*a))[1])
        monkeypatch.setattr(module, "losses_from_tokens", lambda *a: (summed.append(1), real_sum(*a))[1])
    given, specs = tables(spark), SPECS["tofu"]
    wanted = ("forget_Q_A_Prob", "retain_Q_A_Prob", "exact_memorization", "extraction_strength", *(m for m in MIA_PARAMS if m != "mia_gradnorm"))
    store = M.MetricStore(spark, str(tmp_path))
    done = {r["metric"]: r["agg_value"] for r in M.evaluate(store, "t", specs, wanted, given).collect()}
    # one packing for the tokens, sums alone for the reference model's
    assert (len(packed), len(summed)) == (1, 1)
    for name in wanted:
        spec = specs[name]
        own = {role: given[t].where(F.col("dataset") == d).drop("dataset") for role, (t, d) in spec.data.items()}
        alone = get_metric(spec.handler)(Inputs(own), **spec.params).aggregate().first()["agg_value"]
        assert done[name] == pytest.approx(alone, rel=1e-12), name
    # what is stored needs no tokens again, and a plan for it one shuffle of tokens
    plan = M.pack_tokens(given["tokens"], ["dataset", "index", "answer_idx"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    packed.clear()
    M.evaluate(store, "t", specs, wanted, given)
    assert not packed


def test_only_datasets_that_need_whole_texts_are_packed(spark, tmp_path, monkeypatch):
    packed, real = [], M.pack_tokens
    monkeypatch.setattr(M, "pack_tokens", lambda rows, keys: (packed.append({r[0] for r in rows.select("dataset").distinct().collect()}), real(rows, keys))[1])
    given, specs = tables(spark), SPECS["tofu"]
    wanted = ("forget_Truth_Ratio", "ra_Q_A_Prob_normalised", "extraction_strength", "mia_min_k")
    done = {r["metric"]: r["agg_value"] for r in M.evaluate(M.MetricStore(spark, str(tmp_path / "a")), "t", specs, wanted, given).collect()}
    assert packed == [{"TOFU_QA_forget", "TOFU_QA_holdout"}]
    # packed tokens beside the rows are taken as they are, with the same results
    beside = {**given, "tokens_packed": A.pack_tokens(given["tokens"], ["dataset", "index", "answer_idx"])}
    again = {r["metric"]: r["agg_value"] for r in M.evaluate(M.MetricStore(spark, str(tmp_path / "b")), "t", specs, wanted, beside).collect()}
    assert len(packed) == 1 and again.keys() == done.keys() == set(wanted)
    assert all(again[m] == pytest.approx(done[m], rel=1e-12) for m in wanted)


def test_suite_tokens_are_the_same_in_both_layouts(spark):
    from lethe.plans.evaluation import suite_tokens

    given = suite_tokens(spark, "/root/testdata/sf0.001", 5)
    keys = ["dataset", "index", "answer_idx"]
    whole = given["tokens"].where("dataset IN ('TOFU_QA_forget', 'TOFU_QA_holdout')")
    fields = ["label_id", "logprob", "pred_id"]
    rows = A.pack_tokens(whole.select(*keys, "pos", *fields), keys)
    packed = given["tokens_packed"].where("dataset IN ('TOFU_QA_forget', 'TOFU_QA_holdout')").select(*keys, "tokens")
    assert rows.exceptAll(packed).isEmpty() and packed.exceptAll(rows).isEmpty()
    # no token is shuffled for the packed ones
    assert "ObjectHashAggregate" not in packed._jdf.queryExecution().executedPlan().toString()


def test_incremental_run(spark, tmp_path):
    calls = []

    @metric("counting")
    def counting(inputs: Inputs, value: float = 1.0) -> Result:
        calls.append(value)
        return Result(inputs.only().agg(F.lit(value).alias("agg_value")))

    specs = {"a": Spec("counting", {"d": ("t", "x")}), "b": Spec("counting", {"d": ("t", "x")}, {"value": 2.0}),
             "h": Spec("hm_aggregate", parents={"a": ("a", "a"), "b": ("b", "b")})}
    given = {"t": spark.createDataFrame([("x", 1)], "dataset string, index long")}
    store = M.MetricStore(spark, str(tmp_path))
    M.evaluate(store, "r", specs, ("a",), given)
    done = {r["metric"]: r["agg_value"] for r in M.evaluate(store, "r", specs, ("a", "b", "h"), given).collect()}
    assert calls == [1.0, 2.0] and done["h"] == pytest.approx(4 / 3)
    M.evaluate(store, "r", specs, ("h",), given, overwrite=True)
    assert calls == [1.0, 2.0, 1.0, 2.0]
    with pytest.raises(FileNotFoundError):
        M.evaluate(store, "r", specs, ("a",), given, reference_run="unknown")


def test_without_a_reference_run(spark, tmp_path):
    store = M.MetricStore(spark, str(tmp_path))
    done = {r["metric"]: r["agg_value"] for r in M.evaluate(store, "t", SPECS["tofu"], ("forget_quality", "privleak"), tables(spark)).collect()}
    assert set(done) == {"privleak"}
    rows = {r["metric"]: r["agg_value"] for r in store.aggregates().collect()}
    assert rows["forget_quality"] is None
    assert done["privleak"] == pytest.approx(((1 - rows["mia_min_k"]) - 0.5) / (0.5 + 1e-10) * 100)


def test_reference_logs(spark):
    log = spark.createDataFrame([("r", "a", 1.0), ("s", "a", 2.0)], schemas.METRIC_AGG)
    rows = {r["access_key"]: (r["agg_value"], r["missing"]) for r in L.load_reference_logs(log, "r", {"a": "x", "b": "y"}).collect()}
    assert rows == {"x": (1.0, False), "y": (None, True)}
    assert L.load_reference_logs(None, "r", {}) is None
    with pytest.raises(FileNotFoundError):
        L.load_reference_logs(log, "unknown", {"a": "x"})


def test_json_logs(spark, tmp_path):
    for run, summary in (("r1", '{"forget_Q_A_ROUGE": 0.5, "other": 1}'), ("r2", '{"forget_Q_A_ROUGE": 0.25}')):
        (tmp_path / run).mkdir()
        (tmp_path / run / "X_SUMMARY.json").write_text(summary)
        (tmp_path / run / "X_EVAL.json").write_text('{"m": {"agg_value": 0.5, "value_by_index": {"0": {"prob": 1}}}, "n": {"agg_value": null}}')
    rows = {r["run"]: r["value"] for r in L.load_summaries(spark, str(tmp_path), "forget_Q_A_ROUGE").collect()}
    assert rows == {"r1": 0.5, "r2": 0.25}
    with pytest.raises(Exception, match="no other in the summary of r2"):
        L.load_summaries(spark, str(tmp_path), "other").collect()
    logs = {(r["run"], r["metric"]): r["agg_value"] for r in L.metric_logs_from_json(spark, str(tmp_path)).collect()}
    assert logs == {("r1", "m"): 0.5, ("r1", "n"): None, ("r2", "m"): 0.5, ("r2", "n"): None}


def test_console_logs_and_status(spark):
    lines = [("a", "Result for metric x:\t0.5"), ("a", "noise"), ("b", "Result for metric y:\tNone"), ("c", "Result for metric z 1")]
    df = spark.createDataFrame(lines, "run string, value string")
    assert {(r["run"], r["metric"], r["agg_value"]) for r in L.result_lines(df).collect()} == {("a", "x", 0.5), ("b", "y", None)}
    assert {r["run"]: r["status"] for r in L.run_status(df).collect()} == {"a": "success", "b": "success", "c": "failed"}


def test_latest_checkpoint_is_numeric(spark, tmp_path):
    for step in ("9", "10", "100", "x"):
        folder = tmp_path / "run" / f"checkpoint-{step}"
        folder.mkdir(parents=True)
        (folder / "state.json").write_text("{}")
    row = L.latest_checkpoint(L.list_checkpoints(spark, str(tmp_path))).first()
    assert (row["run"], row["step"]) == ("run", 100) and row["path"].endswith("checkpoint-100")


def test_run_ids(spark):
    ids = ["facts_Llama-3_GradDiff_rare_forget10_lr_1e-5_ft", "facts_m_DPO_x_lr_1_ft", "other_m_NPO_x_lr_1_ft", "facts_a_b_NPO_s_lr_3e-05_orig"]
    rows = {r["run_id"]: r for r in RP.parse_run_id(spark.createDataFrame([(i,) for i in ids], "run_id string"), "facts").collect()}
    first = rows[ids[0]]
    assert (first["model"], first["trainer"], first["split"], first["lr"], first["base"]) == ("Llama-3", "GradDiff", "rare_forget10", "1e-5", "ft")
    assert rows[ids[1]]["trainer"] is None and rows[ids[2]]["trainer"] is None and rows[ids[3]]["model"] == "a_b"
    got = spark.createDataFrame([("{'train_loss': 1.25, 'x': 2}",), ("'train_loss':",)], "t string").select(RP.train_loss(F.col("t"))).collect()
    assert [r[0] for r in got] == [1.25, None]
    named = spark.range(1).select(RP.learning_rate_tag(F.lit(3e-5)), RP.short_trainer(F.lit("GradAscent")), RP.short_trainer(F.lit("RMU")), RP.path_safe(F.lit("a/b c"))).first()
    assert tuple(named) == ("3e-05", "GA", "RMU", "a__b_c")


def test_harness_summary(spark):
    group = '{"groups": {"mmlu": {"acc,none": 0.5, "alias": "mmlu"}}, "results": {"mmlu": {"acc,none": 0.1}}}'
    single = '{"results": {"gsm": {"exact_match,strict": "0.25", "note": "n/a"}}}'
    df = spark.createDataFrame([("r", "mmlu", group), ("r", "gsm", single)], "run string, task string, value string")
    rows = {r["key"]: (r["number"], r["raw"]) for r in RP.harness_summary(df).collect()}
    assert rows == {"mmlu/acc": (0.5, "0.5"), "gsm/exact_match": (0.25, "0.25"), "gsm/note": (None, "n/a")}


def test_merge_and_pending(spark):
    old = spark.createDataFrame([("r", "a", 1.0), ("r", "b", None)], schemas.METRIC_AGG)
    new = spark.createDataFrame([("r", "a", 2.0), ("r", "c", 3.0)], schemas.METRIC_AGG)
    merged = {r["metric"]: r["agg_value"] for r in M.merge_results(old, new).collect()}
    assert merged == {"a": 2.0, "b": None, "c": 3.0}
    asked = spark.createDataFrame([("r", m) for m in "abc"], "run string, metric string")
    assert sorted(r["metric"] for r in M.pending_metrics(asked, old).collect()) == ["b", "c"]
    assert M.pending_metrics(asked, old, overwrite=True).count() == 3
    assert math.isclose(M.summarize(merged_df(spark), ["a"]).first()["agg_value"], 2.0)


def merged_df(spark):
    return spark.createDataFrame([("r", "a", 2.0), ("r", "z", 1.0)], schemas.METRIC_AGG)
