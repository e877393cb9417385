"""Named metrics of the three benchmarks and the suites built from them.

Fixed values: metric, dataset and suite names, and their parameters.
"""

from __future__ import annotations

from lethe.metrics.registry import Spec

TOKENS, GENERATIONS, NORMS, LOGITS, REFERENCE_TOKENS = "tokens", "generations", "grad_norms", "logits", "reference_tokens"

MIA_PARAMS = {
    "mia_loss": {}, "mia_min_k": {"k": 0.4}, "mia_min_k_plus_plus": {"k": 0.4}, "mia_zlib": {},
    "mia_gradnorm": {"p": 2}, "mia_reference": {},
}
MODEL_UTILITY = (
    "retain_Q_A_Prob", "retain_Q_A_ROUGE", "retain_Truth_Ratio",
    "ra_Q_A_Prob_normalised", "ra_Q_A_ROUGE", "ra_Truth_Ratio",
    "wf_Q_A_Prob_normalised", "wf_Q_A_ROUGE", "wf_Truth_Ratio",
)
KNOWMEM_STOPWORDS = ("\n\n", "\nQuestion", "Question:")


def _data(table: str, dataset: str) -> dict[str, tuple[str, str]]:
    return {"data": (table, dataset)}


def _attacks(forget: str, holdout: str) -> dict[str, Spec]:
    specs = {}
    for name, params in MIA_PARAMS.items():
        table = NORMS if name == "mia_gradnorm" else TOKENS
        data = {"forget": (table, forget), "holdout": (table, holdout)}
        if name == "mia_reference":
            data |= {"forget_reference": (REFERENCE_TOKENS, forget), "holdout_reference": (REFERENCE_TOKENS, holdout)}
        specs[name] = Spec(name, data, params)
    return specs


def _memorization(dataset: str) -> dict[str, Spec]:
    return {name: Spec(name, _data(TOKENS, dataset)) for name in ("exact_memorization", "extraction_strength")}


def _gibberish(text: str) -> Spec:
    return Spec("classifier_prob", {"logits": (LOGITS, text)}, {"class_id": 0, "text_key": "generation"}, {text: (text, "text")})


PRIVLEAK = Spec(
    "privleak", params={"ref_value": 0.5}, parents={"mia_min_k": ("mia_min_k", "forget")}, reference={"mia_min_k": "retain"}
)


def _correct_wrong(handler: str, correct: str, wrong: str, **params) -> Spec:
    return Spec(handler, params=params, parents={correct: (correct, "correct"), wrong: (wrong, "wrong")})


def _tofu() -> dict[str, Spec]:
    recall = {"rouge_type": "rougeL_recall"}
    datasets = {"forget": "TOFU_QA_forget", "retain": "TOFU_QA_retain", "ra": "TOFU_QA_ra", "wf": "TOFU_QA_wf"}
    specs: dict[str, Spec] = {}
    for group, base in datasets.items():
        plain = "TOFU_QA_retain_eval" if group == "retain" else base
        specs[f"{group}_Q_A_Prob"] = Spec("probability", _data(TOKENS, plain))
        specs[f"{group}_Q_A_ROUGE"] = Spec("rouge", _data(GENERATIONS, plain), recall)
        specs[f"{group}_Q_A_PERT_Prob"] = Spec("probability", _data(TOKENS, f"{base}_pert"))
        if group in ("forget", "retain"):
            specs[f"{group}_Q_A_PARA_Prob"] = Spec("probability", _data(TOKENS, f"{base}_para"))
            correct = f"{group}_Q_A_PARA_Prob"
        else:
            correct = f"{group}_Q_A_Prob"
            specs[f"{group}_Q_A_Prob_normalised"] = _correct_wrong("probability_w_options", correct, f"{group}_Q_A_PERT_Prob")
        aggregator = "closer_to_1_better" if group == "forget" else "true_better"
        specs[f"{group}_Truth_Ratio"] = _correct_wrong("truth_ratio", correct, f"{group}_Q_A_PERT_Prob", aggregator=aggregator)
    for kind in ("PARA", "PERT"):
        specs[f"forget_Q_A_{kind}_ROUGE"] = Spec("rouge", _data(GENERATIONS, f"TOFU_QA_forget_{kind.lower()}"), recall)
    specs["forget_quality"] = Spec(
        "ks_test",
        parents={"forget_truth_ratio": ("forget_Truth_Ratio", "forget")},
        reference={"forget_truth_ratio": "retain"},
    )
    specs["model_utility"] = Spec("hm_aggregate", parents={m: (m, m) for m in MODEL_UTILITY})
    specs["privleak"] = PRIVLEAK
    specs["forget_Q_A_gibberish"] = _gibberish("forget_Q_A_ROUGE")
    return {**specs, **_memorization("TOFU_QA_forget"), **_attacks("TOFU_QA_forget", "TOFU_QA_holdout")}


def _muse() -> dict[str, Spec]:
    f1 = {"rouge_type": "rougeL_f1"}
    knowmem = {**f1, "stopwords": KNOWMEM_STOPWORDS}
    return {
        "forget_knowmem_ROUGE": Spec("rouge", _data(GENERATIONS, "MUSE_forget_knowmem"), knowmem),
        "retain_knowmem_ROUGE": Spec("rouge", _data(GENERATIONS, "MUSE_retain_knowmem"), knowmem),
        "forget_verbmem_ROUGE": Spec("rouge", _data(GENERATIONS, "MUSE_forget_verbmem"), f1),
        "forget_gibberish": _gibberish("forget_verbmem_ROUGE"),
        "privleak": PRIVLEAK,
        **_memorization("MUSE_forget_verbmem"),
        **_attacks("MUSE_MIA_forget", "MUSE_MIA_holdout"),
    }


def _facts() -> dict[str, Spec]:
    recall = {"rouge_type": "rougeL_recall"}
    return {
        "forget_Q_A_ROUGE": Spec("rouge", _data(GENERATIONS, "facts_forget"), recall),
        "retain_Q_A_ROUGE": Spec("rouge", _data(GENERATIONS, "facts_retain"), recall),
    }


SPECS = {"tofu": _tofu(), "muse": _muse(), "facts": _facts()}

SUITES = {
    "tofu": ("forget_quality", "forget_Q_A_Prob", "forget_Q_A_ROUGE", "model_utility", "privleak", "extraction_strength"),
    "muse": ("forget_knowmem_ROUGE", "retain_knowmem_ROUGE", "forget_verbmem_ROUGE", "privleak", "extraction_strength"),
    "facts": ("forget_Q_A_ROUGE",),
}
