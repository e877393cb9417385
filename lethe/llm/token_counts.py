"""Token counts by heap-and-linked-list byte-pair merging, without token ids.

The count of a word is its initial symbols minus its merges.  One narrow pass
over whole texts; counts of words met before in a task are kept in a bounded
table.
"""

from __future__ import annotations

import unicodedata
from os.path import commonprefix

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.bpe import Merges, Words, merge_all, read_merges
from lethe.llm.catalog import query, table

# Fixed value: the word pattern of the lower-casing word-end vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
KEPT_WORDS = 500_000
LONG_WORD = 64


class WordCounts(dict):
    """Tokens of each word met so far; forgets all when full. Long words are never kept."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> int:
        data = word.encode()
        symbols = [self.merges.first[b] for b in data]
        symbols[-1] = self.merges.last[data[-1]]
        count = len(symbols) - merge_all(symbols, self.merges.pairs)
        if len(data) <= LONG_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = count
        return count


# Capital letters of Unicode 16 that Python's tables do not lower yet,
# and the capital sigma, which is lowered without the rule for word ends.
LOWERED = {"\u03a3": "\u03c3", "\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7da": "\ua7db", "\ua7dc": "\u019b"} | {
    chr(0x10D50 + i): chr(0x10D70 + i) for i in range(22)
}


def normal_form(text: str) -> str:
    """NFC, then lower case letter by letter."""
    text = unicodedata.normalize("NFC", text)
    if not text.isascii():
        for capital, small in LOWERED.items():
            if capital in text:
                text = text.replace(capital, small)
    return text.lower()


def _counter(tables):
    def count(batches):
        merges: Merges = tables.value
        words, known = Words(WORDS).find, WordCounts(merges)
        mark = commonprefix(sorted(merges.special))
        specials = regex.compile("|".join(map(regex.escape, sorted(merges.special))) or r"(?!)")
        of = known.__getitem__
        for batch in batches:
            sizes, counts = [], []
            for text in batch["text"]:
                sizes.append(len(text.encode()))
                found, parts = 0, [text]
                if mark in text:
                    parts = specials.split(text)
                    found = len(parts) - 1
                for part in parts:
                    found += sum(map(of, words(normal_form(part))))
                counts.append(found)
            yield pd.DataFrame({"id": batch["id"], "n_bytes": sizes, "n_tokens": counts})

    return count


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_bytes, n_tokens) for every row of `docs`.

    `tokenizer_file` is a tokenizers file with a word-end BPE model, read on the
    driver.  Special strings inside a text count as one token each.  A null or
    empty text has zero bytes and tokens; null and repeated ids are carried
    along; other columns are not read.
    """
    tables = docs.sparkSession.sparkContext.broadcast(read_merges(tokenizer_file))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    counted = texts.mapInPandas(_counter(tables), f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumnRenamed("id", id_col)


@query("op9_token_counts")
def token_counts(spark, sf_dir):
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("*", (F.col("n_tokens") > 2048).alias("over_limit"))
