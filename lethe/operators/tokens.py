"""Tokenising, label masks and padded batches.

A tokenizer is anything with `encode(Column) -> Column` (array<int>) and
`words(Column) -> Column`; the default splits words and punctuation on the JVM.
`HuggingFaceTokenizer` wraps a tokenizer file when that package is installed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.scores import IGNORE_INDEX

PAD_ID, BOS_ID, EOS_ID = 0, 1, 2
FIRST_WORD_ID = 3
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"


@dataclass(frozen=True)
class WordTokenizer:
    """Words and single punctuation marks; ids are hashes, so no vocabulary is held."""

    pad_id: int = PAD_ID
    eos_id: int = EOS_ID

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))

    def encode(self, text: Column) -> Column:
        return F.transform(self.words(text), word_id)

    def separator_ids(self, text: str) -> list[int]:
        """White space carries no token."""
        return []


def word_id(word: Column) -> Column:
    digest = F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int")
    return digest + F.lit(FIRST_WORD_ID)


@dataclass(frozen=True)
class HuggingFaceTokenizer:
    """A tokenizer file, read once per task and applied to Arrow batches.

    The file must be where every executor can read it.
    """

    path: str
    pad_id: int
    eos_id: int

    def encode(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            for texts in batches:
                yield pd.Series([e.ids for e in tokenizer.encode_batch(texts.fillna("").tolist())])

        return encode_batch(text)


# ------------------------------------------------------------ arrays of ids

def truncate(ids: Column, length: int | Column) -> Column:
    return F.slice(ids, F.lit(1), F.lit(length) if isinstance(length, int) else length)


def append_eos(ids: Column, eos_id: int = EOS_ID) -> Column:
    """Close a sequence unless it already ends with the end mark."""
    ended = F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos_id, F.lit(False))
    return F.when(ended, ids).otherwise(F.concat(ids, F.array(F.lit(eos_id))))


def mask_prefix(ids: Column, n: Column) -> Column:
    """Labels: no loss on the first `n` positions.

    The mask keeps its length when it is longer than the ids.
    """
    rest = F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n), rest)


def ones(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1))


def attention_mask(ids: Column, pad_id: int = PAD_ID) -> Column:
    """1 where the id is not the padding id, also for real tokens that equal it."""
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def target_words(words: Column, labels: Column) -> Column:
    """Words at the positions that carry loss.

    Words and labels are paired once; a lookup by position inside the filter
    would build an array of labels taken from structs again for every word.
    """
    paired = F.zip_with(words, labels, lambda w, l: F.struct(w.alias("word"), l.alias("label")))
    return F.transform(F.filter(paired, lambda p: p["word"].isNotNull() & (p["label"] != IGNORE_INDEX)), lambda p: p["word"])


def target_text(words: Column, labels: Column) -> Column:
    return F.array_join(target_words(words, labels), " ")


@F.pandas_udf(T.IntegerType())
def zlib_bytes(text: pd.Series) -> pd.Series:
    """Length of the zlib-compressed UTF-8 text; a null text counts as empty."""
    return text.fillna("").map(lambda t: len(zlib.compress(t.encode("utf-8")))).astype("int32")


def zlib_score(loss: Column, text: Column) -> Column:
    return loss / zlib_bytes(text)


# ------------------------------------------------------------ examples

def chat_tokens(
    df: DataFrame,
    prompt: str,
    response: str,
    tokenizer,
    max_length: int | None = None,
    predict_with_generate: bool = False,
) -> DataFrame:
    """input_ids, labels, attention_mask, no_target for a rendered prompt and answer.

    Prompt and full text stay whole, or are cut to `max_length`; the end mark is
    added after the cut.
    """
    full = tokenizer.encode(F.concat(F.col(prompt), F.col(response)))
    head = tokenizer.encode(F.col(prompt))
    if max_length is not None:
        full, head = truncate(full, max_length), truncate(head, max_length)
    ids = df.withColumn("_full", append_eos(full, tokenizer.eos_id)).withColumn("_head", head)
    return _with_labels(ids, predict_with_generate, F.size("_head"), masked_when_generating=False)


def completion_tokens(
    df: DataFrame,
    prefix: str | None,
    text: str | None,
    tokenizer,
    max_length: int | None = None,
    predict_with_generate: bool = False,
    insert_space: bool = False,
) -> DataFrame:
    """Same columns for a prefix and its continuation; absent columns count as empty.

    The continuation stays whole, or is cut to `max_length` tokens.
    """
    p = optional_text(df, prefix)
    t = optional_text(df, text)
    full = tokenizer.encode(completion_text(p, t, insert_space))
    ids = df.withColumn("_head", tokenizer.encode(p)).withColumn("_all", full)
    kept = F.col("_all") if max_length is None else truncate(F.col("_all"), F.size("_head") + max_length)
    ids = ids.withColumn("_full", kept).drop("_all")
    return _with_labels(
        ids, predict_with_generate, F.greatest(F.size("_head"), F.lit(1)), masked_when_generating=True
    )


def _with_labels(df: DataFrame, generate: bool, masked: Column, masked_when_generating: bool) -> DataFrame:
    inputs = F.col("_head") if generate else F.col("_full")
    labels = F.col("_full") if generate and not masked_when_generating else mask_prefix(F.col("_full"), masked)
    return (
        df.withColumn("input_ids", inputs)
        .withColumn("labels", labels)
        .withColumn("attention_mask", ones(F.col("input_ids")))
        .withColumn("no_target", F.size("_head") >= F.size("_full"))
        .drop("_full", "_head")
    )


def optional_text(df: DataFrame, column: str | None) -> Column:
    """A text column, or "" when the table has none of that name."""
    if column is None or column not in df.columns:
        return F.lit("")
    return F.coalesce(F.col(column), F.lit(""))


def completion_text(prefix: Column, text: Column, insert_space: bool = False) -> Column:
    return F.concat(prefix, F.lit(" " if insert_space else ""), text)


# ------------------------------------------------------------ batches

def assign_batches(df: DataFrame, batch_size: int, index: str = "index") -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(index) / batch_size).cast("long"))


def pad_batches(
    df: DataFrame,
    batch_size: int,
    pad_id: int = PAD_ID,
    padding_side: str = "right",
    index: str = "index",
    variants: Sequence[str] = (),
) -> DataFrame:
    """Pad ids and labels to the longest of their batch.

    Nested examples (answers, roles) are rows told apart by `variants` and are
    padded independently.  A batch holds at most `batch_size` rows per variant.
    """
    if index not in df.columns:
        raise ValueError(f"column {index!r} not found in the dataset")
    if padding_side not in ("left", "right"):
        raise ValueError(f"padding side {padding_side!r} is neither left nor right")
    batch = Window.partitionBy("batch_id", *variants)

    def padded(column: str, value: int) -> Column:
        fill = F.array_repeat(F.lit(value), F.col(f"_width_{column}") - F.size(column))
        parts = (F.col(column), fill) if padding_side == "right" else (fill, F.col(column))
        return F.concat(*parts)

    fields = [("input_ids", pad_id)] + ([("labels", IGNORE_INDEX)] if "labels" in df.columns else [])
    out = assign_batches(df, batch_size, index)
    for column, _ in fields:
        out = out.withColumn(f"_width_{column}", F.max(F.size(column)).over(batch))
    for column, value in fields:
        out = out.withColumn(column, padded(column, value)).drop(f"_width_{column}")
    return out.withColumn("attention_mask", attention_mask(F.col("input_ids"), pad_id))
