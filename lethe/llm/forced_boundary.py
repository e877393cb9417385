"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands next to each other in no token of the vocabulary
can never be joined by a merge, so a cut between them is certain.  Pieces of the
word pattern are cut there as well, every fragment is encoded on its own, and
the ids are concatenated: the result is that of encoding the whole.

One narrow pass over whole texts; ids of pieces met before in a task are kept
in a bounded table.
"""

from __future__ import annotations

import hashlib
import struct
from os.path import commonprefix

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.bpe import Merges, Words, merge_all, read_merges
from lethe.llm.catalog import query, table

# Fixed value: the piece pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES = 500_000
LONG_PIECE = 64
ROWS_OUT = 256


def inner_pairs(merges: Merges) -> set[int]:
    """Byte pairs (a * 256 + b) that stand inside some token; all others force a cut."""
    special = set(merges.special.values())
    return {
        a * 256 + b for i, token in enumerate(merges.spelled) if i not in special for a, b in zip(token, token[1:])
    }


def fragments(data: bytes, inner: set[int]) -> list[bytes]:
    """Cut between all neighbours that stand together in no token."""
    out, start = [], 0
    for i in range(1, len(data)):
        if data[i - 1] * 256 + data[i] not in inner:
            out.append(data[start:i])
            start = i
    out.append(data[start:])
    return out


class PieceIds(dict):
    """Ids of each piece met so far, as little-endian 32-bit integers; forgets all
    when full.  Long pieces are never kept."""

    def __init__(self, merges: Merges, inner: set[int]):
        self.merges, self.inner = merges, inner

    def __missing__(self, piece: str) -> bytes:
        first, pairs = self.merges.first, self.merges.pairs
        ids = []
        for fragment in fragments(piece.encode(), self.inner):
            symbols = [first[b] for b in fragment]
            if len(symbols) > 1 and merge_all(symbols, pairs):
                symbols = [s for s in symbols if s >= 0]
            ids += symbols
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, merges: Merges):
        self.known = PieceIds(merges, inner_pairs(merges))
        self.spelled = merges.spelled
        self.pieces = Words(PIECES).find
        self.special = {s: struct.pack("<I", i) for s, i in merges.special.items()}
        self.mark = commonprefix(sorted(self.special))
        self.marks = regex.compile("(" + ("|".join(map(regex.escape, sorted(self.special))) or r"(?!)") + ")")

    def encode(self, text: str) -> bytes:
        of, find = self.known.__getitem__, self.pieces
        if self.mark not in text:
            return b"".join(map(of, find(text)))
        out = []
        for part in self.marks.split(text):
            out += [self.special[part]] if part in self.special else map(of, find(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def _run(tables, row):
    def over(batches):
        codec = Codec(tables.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):  # ids take more room than their text
                part = batch.iloc[at : at + ROWS_OUT]
                rows = [row(codec, x) for x in part["value"]]
                yield pd.DataFrame({"id": part["id"].array} | {k: [r[k] for r in rows] for k in rows[0]})

    return over


def _apply(docs: DataFrame, tokenizer_file: str, id_col: str, value, row, fields: str) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(read_merges(tokenizer_file))
    narrow = docs.select(F.col(id_col).alias("id"), value.alias("value"))
    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInPandas(_run(tables, row), f"id {id_type}, {fields}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, ids array<int>): the ids of every whole text.

    Special strings inside a text become their own id.  A null or empty text has
    no ids; null and repeated ids of rows are carried along; other columns are
    not read.
    """

    def row(codec, text):
        return {"ids": np.frombuffer(codec.encode(text), dtype="<i4")}

    text = F.coalesce(F.col(text_col), F.lit(""))
    return _apply(docs, tokenizer_file, id_col, text, row, "ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(`id_col`, text): the text of every array of ids, special strings spelled out;
    null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def row(codec, ids):
        return {"text": codec.decode(struct.pack(f"<{len(ids)}I", *ids))}

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return _apply(encoded, tokenizer_file, id_col, ids, row, "text string")


def round_trip(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_tokens, ids_sha256, decoded_sha256): encode every whole text and
    decode its ids again, returning digests only.  Rows are treated as in `encode`."""

    def row(codec, text):
        ids = codec.encode(text)
        decoded = codec.decode(ids).encode()
        return {
            "n_tokens": len(ids) // 4,
            "ids_sha256": hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": hashlib.sha256(decoded).hexdigest(),
        }

    text = F.coalesce(F.col(text_col), F.lit(""))
    return _apply(docs, tokenizer_file, id_col, text, row, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op6_forced_boundary")
def forced_boundary(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
