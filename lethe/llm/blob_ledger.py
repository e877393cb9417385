"""Secret scans over every historical version, once per content.

A version is any row with a text.  Its blob is the SHA-256 of the text.  Only
(blob, rule version) pairs that the ledger has not seen are scanned; findings
are kept per blob and joined back to all versions.

Texts move through one shuffle at most, keyed by the version that stands for
its blob, and only for blobs that have something left to scan.  Everything else
that moves is a digest or a span.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.session import materialise, scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`, kept when `group` has `least` characters.

    A change of pattern needs a new `version`, which makes all blobs unseen for it.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


# Base rules, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign", 1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, ignore_case=True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", 1, r"[0-9a-f]+", least=24),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE

# One row per blob and run: the rule versions that were applied and what they found.
FINDING = "blob binary, rules array<string>, found array<struct<rule:string,start:bigint,end:bigint>>"


def _scanner(rules: Sequence[Rule]):
    compiled = {
        r.tag: (re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)), r.group, r.least) for r in rules
    }

    def scan(batches):
        for batch in batches:
            found = [
                [
                    {"rule": tag, "start": m.start(), "end": m.end()}
                    for tag in missing
                    for pattern, group, least in (compiled[tag],)
                    for m in pattern.finditer(text)
                    if m.end(group) - m.start(group) >= least
                ]
                for text, missing in zip(batch["text"], batch["missing"])
            ]
            yield pd.DataFrame({"blob": batch["blob"], "rules": batch["missing"], "found": found})

    return scan


def blobs_of(versions: DataFrame, id_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """Every version's id columns and its blob; a null text counts as empty."""
    return versions.select(*id_cols, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))


def scan_unseen(
    versions: DataFrame,
    seen: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    id_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that are not in `seen`.

    A rule without a match is listed in `rules` all the same, so that it counts as seen.
    Spans are code points, end exclusive.  Several versions of one blob, repeated
    rows and null ids give one scan of that blob; an empty table gives no rows.
    """
    tags = F.array(*[F.lit(r.tag) for r in rules])
    # null ids are told apart from the text "null" by their own flag
    keyed = versions.select(
        F.xxhash64(*[x for c in id_cols for x in (F.col(c).isNull(), F.col(c).cast("string"))]).alias("version"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("blob", F.unhex(F.sha2("text", 256)))
    # one version stands for a blob; copies collapse on the map side
    standing = keyed.groupBy("blob").agg(F.min("version").alias("version"))
    if seen is not None:
        # a blob has a row per scan, each with other rule versions
        known = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        standing = standing.join(known, "blob", "left").select(
            "blob", "version", F.array_except(tags, F.coalesce("done", F.array().cast("array<string>"))).alias("missing")
        )
    else:
        standing = standing.select("blob", "version", tags.alias("missing"))
    open_pairs = standing.where(F.size("missing") > 0)
    # versions are all but unique, so this join has no hot key; the narrow side is hashed, texts are not sorted
    texts = keyed.select("version", F.col("blob").alias("_blob"), "text")
    todo = texts.join(
        open_pairs.hint("shuffle_hash"), (texts["version"] == open_pairs["version"]) & (F.col("_blob") == F.col("blob"))
    ).select("blob", "text", "missing")
    found = todo.mapInPandas(_scanner(rules), FINDING)
    # rows that repeat id and text were scanned alike; one result stays
    return found.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("found").alias("found"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDING).parquet(path)


def scan_into(
    versions: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    id_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    first: bool = False,
) -> DataFrame:
    """Scan what the ledger folder lacks, append it there, and return the whole ledger.

    `first` starts a new ledger.  A run that fails before its append has changed
    nothing, so it can be repeated.
    """
    spark = versions.sparkSession
    seen = None if first else read_ledger(spark, ledger)
    scan_unseen(versions, seen, rules, id_cols, text_col).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def findings_by_version(
    versions: DataFrame,
    ledger: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """One row per version: id columns, blob and `found`, an array of
    (start, kind_no, kind, end) over all rules, sorted by start, then rule order."""
    order = {r.tag: i for i, r in enumerate(rules)}
    number = F.create_map(*[F.lit(x) for tag, i in order.items() for x in (tag, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.tag, r.kind)])
    some = F.transform(
        F.filter("found", lambda s: s["rule"].isin(list(order))),
        lambda s: F.struct(s["start"].alias("start"), number[s["rule"]].alias("kind_no"), kind[s["rule"]].alias("kind"), s["end"].alias("end")),
    )
    hits = ledger.where(F.size("found") > 0).select("blob", some.alias("some"))
    per_blob = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>")
    return (
        blobs_of(versions, id_cols, text_col)
        .join(per_blob.where(F.size("found") > 0), "blob", "left")
        .select(*id_cols, "blob", F.coalesce("found", empty).alias("found"))
    )


def _listed(found):
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


@query("op4_blob_ledger")
def blob_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ledger = scan_into(docs, scratch_path(spark, "blob-ledger"), first=True)
    rows = findings_by_version(docs, ledger)
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE))

    def count(number: int):
        return F.size(F.filter("found", lambda s: s["kind_no"] == number)).cast("bigint")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return rows.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.lower(F.hex("blob")).alias("blob")
    )
