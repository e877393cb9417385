"""Prompt text from questions, answers and few-shot examples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.text import fill_template


@dataclass(frozen=True)
class Template:
    user_start: str = ""
    user_end: str = ""
    asst_start: str = ""
    asst_end: str = ""
    system: str = ""
    system_tagged: str = ""
    chat: bool = False
    date: str | None = None


# Prompt tags of the model families in use.
PLAIN = Template(user_start="Question: ", user_end="\n", asst_start="Answer: ", asst_end="\n\n")
LLAMA_2_CHAT = Template(user_start="[INST] ", user_end=" [/INST]", asst_start="", asst_end=" ")
LLAMA_3 = Template(
    user_start="<|start_header_id|>user<|end_header_id|>\n\n",
    user_end="<|eot_id|>",
    asst_start="<|start_header_id|>assistant<|end_header_id|>\n\n",
    asst_end="<|eot_id|>",
    chat=True,
)

MOST_EXAMPLE_BYTES = 2**24  # of all examples, which stand in every prompt
NO_EXAMPLES = "array<struct<question:string,answer:string>>"


def few_shot_array(examples: DataFrame, question: str = "question", answer: str = "answer", position: str = "position") -> DataFrame:
    """All examples as one row `few_shot`, in their order.

    Examples go into every prompt, so they are as many as a prompt can hold; more
    than `MOST_EXAMPLE_BYTES` are an error, raised before any are collected.
    """
    lengths = [F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in (question, answer)]
    size = examples.agg(F.sum((lengths[0] + lengths[1]).cast("bigint")).alias("n")).scalar()
    large = F.raise_error(F.lit(f"few-shot examples are larger than {MOST_EXAMPLE_BYTES} bytes")).cast("boolean")
    examples = examples.where(F.when(size > MOST_EXAMPLE_BYTES, large).otherwise(F.lit(True)))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(question).alias("question"), F.col(answer).alias("answer"))))
    return examples.agg(ordered.alias("e")).select(
        F.transform("e", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("few_shot")
    )


def attach_few_shot(df: DataFrame, examples: DataFrame | None, **columns: str) -> DataFrame:
    """The same ordered examples on every row (an empty list without any)."""
    if examples is None:
        return df.withColumn("few_shot", F.array().cast(NO_EXAMPLES))
    return df.withColumn("few_shot", few_shot_array(examples, **columns).scalar())


def render_prompt(template: Template, question: Column, few_shot: Column | None = None) -> Column:
    """System text, filled examples, the question, and the opening of the answer."""
    t = template

    def asked(q: Column) -> Column:
        return F.concat(F.lit(t.user_start), q, F.lit(t.user_end + t.asst_start))

    parts = [F.lit(t.system_tagged)]
    if few_shot is not None:
        parts.append(
            F.array_join(F.transform(few_shot, lambda e: F.concat(asked(e["question"]), e["answer"], F.lit(t.asst_end))), "")
        )
    return F.concat(*parts, asked(question))


def chat_messages(question: Column, answer: Column, few_shot: Column | None = None, system: str = "") -> Column:
    """array<struct<role, content>>: system, then user and assistant in turn."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    parts = [F.array(message("system", F.lit(system)))] if system else []
    if few_shot is not None:
        turns = F.transform(few_shot, lambda e: F.array(message("user", e["question"]), message("assistant", e["answer"])))
        parts.append(F.flatten(turns))
    parts.append(F.array(message("user", question), message("assistant", answer)))
    return F.concat(*parts)


def render_chat(template: Template, messages: Column, generation_prompt: bool = False) -> Column:
    """Messages between the tags of their roles; the system text as it is tagged."""
    t = template

    def tagged(m: Column) -> Column:
        content = m["content"]
        return (
            F.when(m["role"] == "user", F.concat(F.lit(t.user_start), content, F.lit(t.user_end)))
            .when(m["role"] == "assistant", F.concat(F.lit(t.asst_start), content, F.lit(t.asst_end)))
            .otherwise(F.lit(t.system_tagged) if t.system_tagged else content)
        )

    text = F.array_join(F.transform(messages, tagged), "")
    return F.concat(text, F.lit(t.asst_start)) if generation_prompt else text


def few_shot_prompt(example_template: str, query_template: str, few_shot: Column, delimiter: str = "\n\n") -> Column:
    """Filled examples and the open query, joined by the delimiter."""
    filled = F.transform(
        few_shot,
        lambda e: fill_template(F.lit(example_template), {"question": e["question"], "answer": e["answer"]}),
    )
    return F.array_join(F.concat(filled, F.array(F.lit(query_template))), delimiter)


def fill_from_row(df: DataFrame, prompt: Column, columns: Sequence[str] | None = None) -> Column:
    """Replace `{column}` by the row's value, for every column."""
    return fill_template(prompt, {c: F.col(c) for c in (columns or df.columns)})
