"""Repeated substrings by bucket-pointer refinement of sampled suffixes.

A byte is removed when a string of `LENGTH` bytes that covers it starts
elsewhere too.  Suffixes are sampled by content: the anchor of a window of that
length is the position of its least hash, so equal windows have their anchor at
the same place, and every anchor stands for a run of windows.

1. Anchors are put into buckets by the q-gram that starts there.  A bucket with
   one anchor is settled: none of its windows is repeated.
2. Buckets are refined by identifiers of what stands at later and earlier
   offsets: (q-gram, whole run).  Runs in one refined bucket are repeated as a
   whole.  Where a bucket falls apart, one run per part goes on.
3. The same is done with blocks of `BLOCK` neighbouring windows (the bytes
   they share, the bytes they span), and, where those fall apart, with single
   windows.

Each step groups identifiers with sums before the shuffle and passes only what
it left open to the next; members of one refined bucket are stood for by one,
so a passage in a third of all documents costs one row per task.  Texts move
once, and those with something to remove or to settle once or twice more.

The same buckets take strings of words beside those of bytes, for a passage of
many short words has less than `LENGTH` bytes.  A word is a unit of 64 bits
there, and the words that a repeated string covers are counted, not removed.

Identifiers of two buckets (128 bits) decide that strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.llm.members import likely
from lethe.session import materialise

LENGTH = 400
RUN = 256  # q-gram positions in a window; the q-gram has the rest of its length
BLOCK = 16
PIECE = 1 << 22  # windows looked at together
_LOW = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SECOND = 0x5EED
HOT = 1000  # an identifier is hot when it holds more than one of HOT rows
ROWS = 1 << 12  # rows of a frame that a task hands back
TEXTS = 1 << 9  # the same where rows hold texts


@dataclass(frozen=True)
class Shape:
    length: int = LENGTH
    run: int = RUN
    words: bool = False  # units are words, not bytes

    @property
    def gram(self) -> int:
        return self.length - self.run + 1

    def units(self, data: bytes) -> bytes | np.ndarray:
        if not self.words:
            return data
        found = data.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


PASSAGE = Shape(50, 40, words=True)


def _letters() -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _piece(data: np.ndarray, shape: Shape, letters: np.ndarray) -> np.ndarray:
    """Anchor position of every window of one piece."""
    h = data if shape.words else letters[data]
    reach = min(4, shape.gram.bit_length() - 1)  # hashes of up to 16 bytes, never longer than the q-gram
    for k in range(reach):
        h = h[: -(1 << k)] * np.uint64(0x100000001B3 + 2 * k) + (h[(1 << k) :] ^ (h[(1 << k) :] >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(31))) * _MIX
    at = len(data) - shape.gram + 1
    value = (h[:at] & ~_LOW) | np.arange(at, dtype=np.uint64)  # equal hashes: the first position
    rows = -(-at // shape.run)
    padded = np.full(rows * shape.run, np.uint64(2**64 - 1))
    padded[:at] = value
    padded = padded.reshape(rows, shape.run)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - shape.length + 1
    return (np.minimum(after[:windows], before[shape.run - 1 : shape.run - 1 + windows]) & _LOW).astype(np.int64)


def runs(data: bytes | np.ndarray, shape: Shape, letters: np.ndarray) -> list[tuple[int, int, int]]:
    """(anchor, first window, last window) in order; none for texts shorter than a window."""
    windows = len(data) - shape.length + 1
    if windows < 1:
        return []
    array = data if shape.words else np.frombuffer(data, dtype=np.uint8)
    anchors = np.concatenate(
        [_piece(array[p : p + PIECE + shape.length - 1], shape, letters) + p for p in range(0, windows, PIECE)]
    )
    cut = np.flatnonzero(np.diff(anchors)) + 1
    first = np.r_[0, cut]
    return list(zip(anchors[first].tolist(), first.tolist(), (np.r_[cut, windows] - 1).tolist()))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class _Runs:
    """The units of one text and its runs, those of bytes numbered before those of words."""

    def __init__(self, data: bytes, split: int, shapes: list[Shape], letters: np.ndarray):
        self.data, self.split, self.shapes, self.letters = data, split, shapes, letters
        self.units: dict = {}
        self.found: dict = {}

    def sequence(self, unit: int):
        if unit not in self.units:
            self.units[unit] = self.shapes[unit].units(self.data)
        return self.units[unit]

    def run(self, number: int) -> tuple[int, int, int, int]:
        """(unit, anchor, first window, last window)"""
        unit = int(number >= self.split)
        if unit not in self.found:
            self.found[unit] = runs(self.sequence(unit), self.shapes[unit], self.letters)
        return (unit, *self.found[unit][number - unit * self.split])


def _frames(rows: Iterator[tuple], columns: list[str], size: int = ROWS) -> Iterator[pd.DataFrame]:
    """Small frames, so that memory does not grow with what a batch of texts gives."""
    while some := list(islice(rows, size)):
        yield pd.DataFrame(some, columns=columns)


def _sampler(shapes: list[Shape]):
    def sample(batches):
        letters = _letters()
        for batch in batches:
            sizes, counts, keys, hulls = [], [], [], []
            for text in batch["text"]:
                data = text.encode()
                sizes.append([])
                counts.append([])
                grams, spans = [], []
                for shape in shapes:
                    units = shape.units(data)
                    found = runs(units, shape, letters)
                    sizes[-1].append(len(units))
                    counts[-1].append(len(found))
                    grams += [xxhash.xxh3_64_intdigest(units[a : a + shape.gram]) for a, _, _ in found]
                    spans += [xxhash.xxh3_64_intdigest(units[lo : hi + shape.length], SECOND) for _, lo, hi in found]
                keys.append(np.array(grams, np.uint64).view(np.int64))
                hulls.append(np.array(spans, np.uint64).view(np.int64))
            yield pd.DataFrame(
                {"id": batch["id"], "v": batch["v"], "sha": batch["sha"], "sizes": sizes, "counts": counts, "keys": keys, "hulls": hulls}
            )

    return sample


def _blocker(shapes: list[Shape]):
    """Blocks of windows with their distance from the anchor in [k * BLOCK, (k + 1) * BLOCK)."""

    def blocks(batch, letters):
        for r, text, split, ords, opens in zip(batch["r"], batch["text"], batch["split"], batch["ord"], batch["open"]):
            own = _Runs(text.encode(), split, shapes, letters)
            for number, opened in zip(ords.tolist(), opens.tolist()):
                u, a, lo, hi = own.run(number)
                units, length = own.sequence(u), shapes[u].length
                for k in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
                    near, far = k * BLOCK, k * BLOCK + BLOCK - 1
                    # equal windows are equally far from their anchors, so only like blocks are compared:
                    # one stretch seen from two anchors is one occurrence
                    core = xxhash.xxh3_64_intdigest(units[a - near : max(0, a - far + length)], k + 1)  # empty if shorter than a block
                    if a >= far and a - near + length <= len(units):
                        hull = xxhash.xxh3_64_intdigest(units[a - far : a - near + length], SECOND)
                    else:  # the block sticks out of the text: like no other
                        hull = xxhash.xxh3_64_intdigest(f"{r} {u} {a} {k}".encode())
                    yield r, u, max(lo, a - far), min(hi, a - near), opened, _signed(core), _signed(hull)

    def block(batches):
        letters = _letters()
        for batch in batches:
            yield from _frames(blocks(batch, letters), ["r", "unit", "lo", "hi", "open", "key", "hull"])

    return block


def _windower(shapes: list[Shape]):
    def windows(batch):
        for r, text, *parts in zip(*(batch[c] for c in ("r", "text", "unit", "lo", "hi", "open"))):
            own = _Runs(text.encode(), 0, shapes, None)
            for u, lo, hi, opened in zip(*(p.tolist() for p in parts)):
                units, length = own.sequence(u), shapes[u].length
                for s in range(lo, hi + 1):
                    whole = xxhash.xxh3_128_intdigest(units[s : s + length])
                    yield r, u, s, s, opened, _signed(whole >> 64), _signed(whole & (2**64 - 1))

    def window(batches):
        for batch in batches:
            yield from _frames(windows(batch), ["r", "unit", "lo", "hi", "open", "key", "hull"])

    return window


def _covered(gone: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal stretches (begin, end) under windows of `length` that start in the ranges `gone`."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(gone):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def _remover(shapes: list[Shape]):
    def cuts(batch, letters):
        for r, text, split, done, *spans in zip(*(batch[c] for c in ("r", "text", "split", "done", "unit", "lo", "hi"))):
            data = text.encode()
            own = _Runs(data, split, shapes, letters)
            gone = [[] for _ in shapes]
            for number in done.tolist():
                u, _, lo, hi = own.run(number)
                gone[u].append((lo, hi))
            for u, lo, hi in zip(*(s.tolist() for s in spans)):
                gone[u].append((lo, hi))
            covered = [_covered(g, shape.length) for g, shape in zip(gone, shapes)]
            sums = [sum(end - begin for begin, end in c) for c in covered]
            rest = sha = None
            if covered[0]:
                edges = [0, *(at for stretch in covered[0] for at in stretch), len(data)]
                kept = b"".join(data[begin:end] for begin, end in zip(edges[::2], edges[1::2]))
                sha = hashlib.sha256(kept).hexdigest()
                # a character that a cut has split is left out of the text, not of its digest
                rest = kept.decode(errors="ignore")
            yield r, sums[0], len(covered[0]), sha, rest, sum(sums[1:])

    def remove(batches):
        letters = _letters()
        for batch in batches:
            yield from _frames(cuts(batch, letters), ["r", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words"], TEXTS)

    return remove


def _refine(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Refine buckets `key` by `hull`.

    Returns the identifiers (key, hull, m) held m > 1 times, and one member per
    part of every bucket that fell apart and has an unsettled part: (r, ..., open).
    """
    rest = [c for c in members.columns if c not in ("key", "hull", "open")]
    parts = materialise(
        members.groupBy("key", "hull").agg(F.count("*").alias("m"), F.min(F.struct("open", *rest)).alias("one")), name
    )
    single = (F.col("m") == 1) & F.col("one.open")
    apart = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(single).alias("unsettled")).where("parts > 1 AND unsettled")
    onward = parts.join(apart.select("key"), "key").select(*[f"one.{c}" for c in rest], single.alias("open"))
    return parts.where("m > 1").select("key", "hull", "m"), onward


def _held_twice(rows: DataFrame, repeated: DataFrame, *by: str) -> DataFrame:
    """The rows whose identifiers are in `repeated` (identifiers, m), m being their number of rows.

    A passage in a third of all documents is one identifier.  Fewer than HOT of
    them hold more than one of HOT of these rows each, so these few are broadcast
    and their rows stay where they are; the others are shuffled, if a map of bits
    does not rule them out.
    """
    total = repeated.agg(F.sum("m")).head()[0] or 0
    hot = repeated.where(F.col("m") * HOT > total).select(*by, F.lit(True).alias("hot"))
    flagged = rows.join(F.broadcast(hot), list(by), "left")
    cold = repeated.where(F.col("m") * HOT <= total).select(*by)
    often = flagged.where("hot").select(*rows.columns)
    others = likely(flagged.where("hot IS NULL").select(*rows.columns), cold, *by)
    return often.unionByName(others.join(cold, list(by)).select(*rows.columns))


def _gathered(rows: DataFrame, *fields: str) -> DataFrame:
    """Per document its rows, as `parts`; as many as the document has windows at most."""
    return rows.groupBy("r").agg(F.collect_list(F.struct(*fields)).alias("parts"))


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """`rows` with their texts, the only ones that move."""
    # rows that repeat id and text collapse before the shuffle, which also serves the join
    return rows.join(likely(texts, rows, "v", "sha").dropDuplicates(["v", "sha"]), ["v", "sha"])


@dataclass(frozen=True)
class Found:
    """`documents` (r, id, v, n, sha, whole, passage_words), `cut` (r, n_removed,
    n_spans, kept_sha256, kept, n_passage_words) for those that lose a part or
    hold a passage, and `texts` (v, sha, text) of all rows.

    `passage_words` is the number of words where all of them are in passages,
    else 0; `kept` and its digest are null where nothing is removed."""

    documents: DataFrame
    cut: DataFrame
    texts: DataFrame


def repeated_substrings(
    docs: DataFrame,
    length: int = LENGTH,
    run: int = RUN,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage: Shape | None = None,
) -> Found:
    """Find every byte covered by a string of `length` bytes that also starts elsewhere,
    and every word covered by such a string of words, where `passage` gives their shape.

    Strings are taken from the UTF-8 bytes of whole texts and never cross
    documents.  Null and empty texts, and those shorter than `length`, lose
    nothing.  Repeated rows count as different documents, so long ones lose
    everything; null ids are carried along; other columns are not read; an empty
    table gives empty tables.
    """
    shapes = [Shape(length, run), *([passage] if passage else [])]
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col).isNull(), F.col(id_col)).alias("v"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text.alias("text"),
    )
    id_type = narrow.schema["id"].dataType.simpleString()
    sampled = materialise(
        narrow.mapInPandas(
            _sampler(shapes),
            f"id {id_type}, v bigint, sha binary, sizes array<bigint>, counts array<int>, keys array<bigint>, hulls array<bigint>",
        ).select(F.monotonically_increasing_id().alias("r"), "*"),
        "anchors",
    )
    each = sampled.select("r", F.posexplode(F.arrays_zip("keys", "hulls")).alias("ord", "a")).select(
        "r", "ord", F.col("a.keys").alias("key"), F.col("a.hulls").alias("hull"), F.lit(True).alias("open")
    )
    keys = sampled.select(F.explode("keys").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared-keys")
    # the few others that pass are alone in their bucket, which settles them
    alive = materialise(likely(each, shared, "key"), "shared-anchors")
    whole_runs, onward = _refine(alive, "runs")
    done = _held_twice(alive, whole_runs, "key", "hull").select("r", "ord", F.lit(1).alias("state"))
    marks = (
        done.union(onward.select("r", "ord", F.when(F.col("open"), 2).otherwise(3)))
        .groupBy("r")
        .agg(F.collect_list(F.struct("ord", "state")).alias("marks"))
    )
    marked = materialise(
        marks.select(
            "r",
            F.transform(F.filter("marks", lambda m: m["state"] == 1), lambda m: m["ord"]).alias("done"),
            F.transform(
                F.filter("marks", lambda m: m["state"] > 1),
                lambda m: F.struct(m["ord"].alias("ord"), (m["state"] == 2).alias("open")),
            ).alias("parts"),
        ),
        "marks",
    )
    facts = sampled.select("r", "id", "v", "sha", "sizes", "counts", F.col("counts")[0].alias("split")).join(marked, "r", "left")
    of_bytes = F.size(F.filter("done", lambda o: o < F.col("split")))

    def all_of(unit: int, settled):
        """Every window of the text is repeated: its text is not needed to know what stays."""
        return F.coalesce((settled == F.col("counts")[unit]) & (settled > 0), F.lit(False))

    whole = all_of(0, of_bytes)
    in_passages = all_of(1, F.size("done") - of_bytes) if passage else F.lit(False)
    known = (whole | (of_bytes == 0)) & (in_passages | (F.size("done") == of_bytes))
    documents = facts.select(
        "r",
        "id",
        "v",
        F.col("sizes")[0].alias("n"),
        "sha",
        whole.alias("whole"),
        (F.when(in_passages, F.col("sizes")[1]).otherwise(0) if passage else F.lit(0)).cast("bigint").alias("passage_words"),
    )
    wanted = facts.where((F.size("parts") > 0) | ((F.size("done") > 0) & ~known)).select("r", "v", "sha", "split", "done", "parts", known.alias("known"))
    wanted = materialise(wanted, "wanted")
    every = narrow.select("v", "sha", "text")
    texts = materialise(
        _with_texts(wanted, every).select("r", "text", "split", "done", "parts", "known"), "cut-texts", compression="zstd"
    )
    fields = "r bigint, unit int, lo bigint, hi bigint, open boolean, key bigint, hull bigint"
    unsettled = texts.where(F.size("parts") > 0)
    blocks = materialise(unsettled.select("r", "text", "split", "parts.ord", "parts.open").mapInPandas(_blocker(shapes), fields), "blocks")
    whole_blocks, onward = _refine(blocks, "block-parts")
    settled = _held_twice(blocks, whole_blocks, "key", "hull").where("open").select("r", "unit", "lo", "hi")
    again = unsettled.select("r", "text").join(_gathered(onward, "unit", "lo", "hi", "open"), "r")
    parts = [f"parts.{c}" for c in ("unit", "lo", "hi", "open")]
    windows = materialise(again.select("r", "text", *parts).mapInPandas(_windower(shapes), fields), "windows")
    twice = materialise(windows.groupBy("key", "hull").agg(F.count("*").alias("m")).where("m > 1"), "repeated-windows")
    spans = _gathered(
        settled.union(_held_twice(windows, twice, "key", "hull").where("open").select("r", "unit", "lo", "hi")), "unit", "lo", "hi"
    ).withColumnRenamed("parts", "spans")
    none = F.array().cast("array<struct<unit:int,lo:bigint,hi:bigint>>")
    cut = (
        texts.select("r", "text", "split", "done", "known")
        .join(spans, "r", "left")
        .where(((F.size("done") > 0) & ~F.col("known")) | F.col("spans").isNotNull())
        .withColumn("spans", F.coalesce("spans", none))
        .select("r", "text", "split", "done", "spans.unit", "spans.lo", "spans.hi")
        .mapInPandas(
            _remover(shapes),
            "r bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string, n_passage_words bigint",
        )
    )
    return Found(documents, cut, every)


@query("op10_bucket_refinement")
def bucket_refinement(spark, sf_dir):
    found = repeated_substrings(table(spark, sf_dir, "documents"), passage=PASSAGE)
    cut = found.cut.withColumnRenamed("kept", "rest")

    def pick(part, all_gone, untouched):
        return F.coalesce(F.col(part), F.when(F.col("whole"), all_gone).otherwise(untouched)).alias(part)

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    counted = found.documents.join(cut, "r", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        pick("n_removed", F.col("n"), zero),
        pick("n_spans", one, zero),
        pick("kept_sha256", F.lit(EMPTY_SHA), F.lower(F.hex("sha"))),
        pick("rest", F.lit(""), F.lit(None)),
        F.coalesce("n_passage_words", "passage_words").alias("n_passage_words"),
        "v",
        "sha",
    )
    rows = materialise(counted, "counted", compression="zstd")
    # whole texts move once, and only those that lose nothing
    untouched = _with_texts(rows.where("rest IS NULL"), found.texts).withColumn("rest", F.col("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("rest").alias("text"), "n_passage_words"]
    return rows.where("rest IS NOT NULL").select(*names).unionByName(untouched.select(*names))
