"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, _EDGES, "")


def cut_at_stopwords(text: Column, stopwords: Sequence[str], eos: str = "") -> Column:
    """Keep what comes before the first stop word, the end mark first; then strip."""
    for word in (eos, *stopwords):
        if word:
            text = F.substring_index(text, word, 1)
    return strip(text)


def strip_prompt(full: Column, prompt: Column) -> Column:
    """Remove every occurrence of the prompt, then strip."""
    return strip(F.when(F.length(prompt) > 0, F.replace(full, prompt, F.lit(""))).otherwise(full))


def escape_literal(text: Column) -> Column:
    """Backslash and quote escaped, line breaks and tabs turned to blanks."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.translate(escaped, "\n\r\t", "   ")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace `{key}` by the value of the column of that name."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("None")))
    return template


MODEL_TYPO = ("instract", "instruct")


def model_name_text(name: str) -> str:
    """Last path part, trimmed, lower case, the usual typo mended, blanks to dashes."""
    return "-".join(name.rpartition("/")[2].strip().lower().replace(*MODEL_TYPO).split())


def clean_model_name(name: Column) -> Column:
    """The same rule for a column of names."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(F.replace(F.lower(strip(last)), *map(F.lit, MODEL_TYPO)), r"\s+", "-")
