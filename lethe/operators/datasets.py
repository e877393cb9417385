"""Training and evaluation datasets as tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.operators import pairing
from lethe.operators.chunks import chunk_corpus
from lethe.operators.order import dense_index
from lethe.operators.prompts import Template, attach_few_shot, chat_messages, render_chat, render_prompt
from lethe.operators.tokens import chat_tokens, completion_tokens, mask_prefix, ones, optional_text, pad_batches
from lethe.functions.text import model_name_text
from lethe.operators.triples import require_columns

GOLD_LIMIT = 0.5

# Normalised model name to its recall and similarity column.
MODEL_COLUMNS = {
    "llama-3.2-1b-instruct": ("gen_recall_Llama_1b_Instract", "bert_sim_Llama_1b_Instract"),
    "llama-3.2-3b-instruct": ("gen_recall_Llama_3b_Instract", "bert_sim_Llama_3b_Instract"),
    "llama-3.1-8b-instruct": ("gen_recall_Llama_8b_Instract", "bert_sim_Llama_8b_Instract"),
    "gemma-7b-it": ("gen_recall_Gemma_7b_IT", "bert_sim_Gemma_7b_IT"),
    "zephyr-7b-beta": ("gen_recall_Zephyr_7b_Beta", "bert_sim_Zephyr_7b_Beta"),
    "phi-3.5-mini-instruct": ("gen_recall_Phi3_5_mini_Instruct", "bert_sim_Phi3_5_mini_Instruct"),
    "phi3.5-mini-instruct": ("gen_recall_Phi3_5_mini_Instruct", "bert_sim_Phi3_5_mini_Instruct"),
}
FLAG_COLUMNS = {"Llama-3.2-1B-Instruct": ("know_llama3_1b", "emb_llama3_1b")}


def normal_model_name(name: str) -> str:
    """The rule of `clean_model_name` for a name known when the plan is made."""
    return model_name_text(name)


def metric_columns(model_name: str) -> tuple[str, str]:
    key = normal_model_name(model_name)
    if key not in MODEL_COLUMNS:
        raise NotImplementedError(f"no gold-set columns for model {model_name!r} ({key!r})")
    return MODEL_COLUMNS[key]


def gold_by_scores(df: DataFrame, model_name: str) -> DataFrame:
    """Rows whose recall and similarity are both below one half; null, NaN and
    text that is no number are dropped."""
    columns = metric_columns(model_name)
    require_columns(df, columns)
    low = [F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)) < GOLD_LIMIT for c in columns]
    return df.where(low[0] & low[1])


def gold_by_flags(df: DataFrame, model_name: str) -> DataFrame:
    """Rows the model is not known to know; a null flag counts as not known."""
    if model_name not in FLAG_COLUMNS:
        raise NotImplementedError(f"no gold-set flags for model {model_name!r}")
    unknown = [~F.coalesce(F.col(c), F.lit(False)) for c in require_columns_of(df, FLAG_COLUMNS[model_name])]
    return df.where(unknown[0] & unknown[1])


def require_columns_of(df: DataFrame, columns: tuple[str, ...]) -> tuple[str, ...]:
    require_columns(df, columns)
    return columns


def add_index(df: DataFrame, order: str) -> DataFrame:
    return dense_index(df, order)


def first_examples(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in dataset order."""
    return df.where(F.col("index") < n)


def explode_answers(df: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per answer with its `answer_idx`; plain text is answer 0."""
    if isinstance(df.schema[answer].dataType, T.ArrayType):
        rest = [c for c in df.columns if c != answer]
        return df.select(*rest, F.posexplode(answer).alias("answer_idx", answer))
    return df.withColumn("answer_idx", F.lit(0))


def qa_dataset(
    df: DataFrame,
    template: Template,
    tokenizer,
    question: str = "question",
    answer: str = "answer",
    few_shot: DataFrame | None = None,
    max_length: int | None = None,
    predict_with_generate: bool = False,
) -> DataFrame:
    """Questions with a dense `index` to tokens and labels, one row per answer.

    Tagged prompts are cut to `max_length` where one is given, chat templates never.
    """
    rows = attach_few_shot(explode_answers(df, answer), few_shot)
    q, a, shots = F.col(question), F.col(answer), F.col("few_shot")
    if template.chat:
        messages = chat_messages(q, a, shots, template.system)
        rows = rows.withColumn("_messages", messages)
        before = F.slice(F.col("_messages"), F.lit(1), F.size("_messages") - 1)
        rows = rows.withColumn("_prompt", render_chat(template, before, generation_prompt=True))
        rows = rows.withColumn("_response", F.concat(a, F.lit(template.asst_end))).drop("_messages")
        limit = None
    else:
        rows = rows.withColumn("_prompt", render_prompt(template, q, shots)).withColumn("_response", a)
        limit = max_length
    made = chat_tokens(rows, "_prompt", "_response", tokenizer, limit, predict_with_generate)
    return made.drop("_prompt", "_response", "few_shot")


def qa_with_idk(df: DataFrame, pool: DataFrame, template: Template, tokenizer, return_original: bool = True, seed: int = 0, answer: str = "answer", **kw: Any) -> DataFrame:
    """Rows with `variant` original or alternate, the alternate a random refusal."""
    return qa_dataset(pairing.idk_pair(df, pool, answer, return_original, seed), template, tokenizer, answer=answer, **kw)


def qa_with_alternate(df: DataFrame, alternate: str, template: Template, tokenizer, return_original: bool = True, answer: str = "answer", **kw: Any) -> DataFrame:
    paired = pairing.alternate_pair(df, alternate, answer, return_original)
    return qa_dataset(paired, template, tokenizer, answer=answer, **kw)


def completion_dataset(df: DataFrame, tokenizer, prefix: str = "prompt", text: str = "text", **kw: Any) -> DataFrame:
    return completion_tokens(df, prefix, text, tokenizer, **kw)


def pretraining_dataset(df: DataFrame, tokenizer, order: str, text: str = "text", max_length: int = 2048, **kw: Any) -> DataFrame:
    """Chunks with labels; no loss on the first token."""
    chunks = chunk_corpus(df, tokenizer, max_length, order, text, **kw)
    return chunks.withColumn("labels", mask_prefix(F.col("input_ids"), F.lit(1))).withColumn(
        "attention_mask", ones(F.col("input_ids"))
    )


def multi_answer_dataset(
    df: DataFrame,
    tokenizer,
    order: str,
    question: str = "question",
    answers: str = "possible_answers",
    gold: Callable[[DataFrame], DataFrame] | None = None,
    seed: int = 0,
    **kw: Any,
) -> DataFrame:
    """Gold filter, then index, then one answer per row, then tokens.

    `answers` may be a list, of which one is chosen, or plain text.
    """
    indexed = add_index(gold(df) if gold else df, order)
    chosen: Column
    if answers in indexed.columns and isinstance(indexed.schema[answers].dataType, T.ArrayType):
        chosen = pairing.pick_answer(F.col(answers), F.col("index"), seed)
    else:
        chosen = optional_text(indexed, answers)
    rows = indexed.withColumn("_question", optional_text(indexed, question)).withColumn("chosen_answer", chosen)
    return completion_tokens(rows, "_question", "chosen_answer", tokenizer, **kw).drop("_question")


def scored_answer_dataset(df: DataFrame, tokenizer, order: str, model_name: str = "Llama-3.2-1B-Instruct", gold_set: bool = False, **kw: Any) -> DataFrame:
    gold = (lambda d: gold_by_scores(d, model_name)) if gold_set else None
    return multi_answer_dataset(df, tokenizer, order, answers=kw.pop("answers", "answer"), gold=gold, **kw)


def flagged_answer_dataset(df: DataFrame, tokenizer, order: str, model_name: str = "Llama-3.2-1B-Instruct", gold_set: bool = False, **kw: Any) -> DataFrame:
    gold = (lambda d: gold_by_flags(d, model_name)) if gold_set else None
    return multi_answer_dataset(df, tokenizer, order, gold=gold, **kw)


DATASET_HANDLERS: dict[str, Callable[..., DataFrame]] = {
    "qa": qa_dataset,
    "qa_with_idk": qa_with_idk,
    "qa_with_alternate": qa_with_alternate,
    "pretraining": pretraining_dataset,
    "completion": completion_dataset,
    "multi_answer": flagged_answer_dataset,
    "scored_answer": scored_answer_dataset,
    "forget_retain": pairing.forget_retain,
}


def register_dataset(name: str, handler: Callable[..., DataFrame]) -> None:
    DATASET_HANDLERS[name] = handler


COLLATOR_HANDLERS: dict[str, Callable[..., DataFrame]] = {"supervised": pad_batches}


def register_collator(name: str, handler: Callable[..., DataFrame]) -> None:
    COLLATOR_HANDLERS[name] = handler


def collate(df: DataFrame, handler: str, **args: Any) -> DataFrame:
    """Batches made by a registered collator."""
    if handler not in COLLATOR_HANDLERS:
        raise NotImplementedError(f"collator {handler!r} is not registered")
    return COLLATOR_HANDLERS[handler](df, **args)


def get_datasets(specs: dict[str, dict[str, Any]]) -> DataFrame | dict[str, DataFrame]:
    """Build named datasets: {"name": {"handler", "args", "access_key"?}}.

    A single dataset comes back bare, several under their access names.
    """
    built = {}
    for name, spec in specs.items():
        handler = spec.get("handler")
        if handler not in DATASET_HANDLERS:
            raise NotImplementedError(f"dataset {name!r}: handler {handler!r} is not registered")
        built[spec.get("access_key", name)] = DATASET_HANDLERS[handler](**spec["args"])
    return next(iter(built.values())) if len(built) == 1 else built


def get_data(
    splits: dict[str, DataFrame], columns: list[str], mode: str = "train", anchor: str = "forget", seed: int = 0, epoch: int = 0
) -> dict[str, DataFrame]:
    """Splits as they are, or for unlearning all but eval and test paired into `train`."""
    if mode == "train":
        return dict(splits)
    if mode != "unlearn":
        raise ValueError(f"mode {mode!r} is neither train nor unlearn")
    kept = {k: v for k, v in splits.items() if k in ("eval", "test")}
    paired = pairing.forget_retain(splits.get("forget"), splits.get("retain"), columns, anchor, seed, epoch)
    return {**kept, "train": paired}
