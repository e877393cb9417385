"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a named, versioned mask of bits, so
another policy or an ablation never reads a text again.  DataFrame functions
only: one narrow pass, no shuffle, whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.catalog import query, table
from lethe.session import materialise

WORD_BREAK = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`failed` is an SQL condition over the measurements; `bit` never changes its meaning."""

    bit: int
    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    """The rules, by name, that a document must not fail."""

    name: str
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 40 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def _windows(words: Column, n: Column) -> Column:
    """(start, hash) sources: the starts of all windows, empty when there are too few words."""
    return F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))


def _window_hash(words: Column, start: Column) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(WINDOW)])


def _repeated_words(words: Column, starts: Column) -> Column:
    """Words inside windows whose five words occur at two starts or more.

    Windows are compared as strings.  Sorting brings equal ones together; the
    starts of those, in order, give the length of the union of their spans.
    """
    spelled = F.array_sort(
        F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    )

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.get(s, k - 1)["w"]
            after = F.get(s, k + 1)["w"]
            return F.coalesce(x["w"] == before, F.lit(False)) | F.coalesce(x["w"] == after, F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    # a one-element array binds the sorted windows to a name, so that they are sorted once
    found = F.get(F.transform(F.array(spelled), repeated), 0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    union = F.aggregate(
        found,
        start,
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")),
    )
    return union["n"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col` and the measurements, all bigint.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (of those, equal to an earlier one) and n_repeat_words.
    A null or empty text has zeros everywhere; null or repeated ids are carried
    along; other columns are not read.
    """
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = text.select(
        "id",
        "text",
        F.filter(F.split("text", WORD_BREAK), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(NON_SPACE)).alias("lines"),
    )
    sized = split.select("*", F.size("words").alias("n"))
    started = sized.select("*", _windows(F.col("words"), F.col("n")).alias("starts"))
    hashed = started.select("*", F.transform("starts", lambda i: _window_hash(F.col("words"), i)).alias("hashes"))
    # windows with different hashes are different; only texts with equal hashes are looked at again
    suspect = F.size(F.array_distinct("hashes")) < F.size("hashes")
    repeats = F.when(suspect, _repeated_words(F.col("words"), F.col("starts"))).otherwise(F.lit(0))
    measured = {
        "n_words": F.col("n"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeats,
    }
    return hashed.select(F.col("id").alias(id_col), *[measured[m].cast("bigint").alias(m) for m in MEASURES])


def ledger(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Measurements and `failure_bits` (bigint, bit `rule.bit` set where the rule fails)."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, id_col, text_col).select("*", bits.alias("failure_bits"))


def apply_policy(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add `kept` (no bit of the policy is set) and `policy` (its name and version)."""
    wanted = F.lit(mask(policy, rules)).cast("bigint")
    return rows.select(
        "*",
        (F.col("failure_bits").bitwiseAND(wanted) == 0).alias("kept"),
        F.lit(f"{policy.name}-{policy.version}").alias("policy"),
    )


def sole_failure(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """The bit that alone rejects a document under the policy (bigint), else 0."""
    failed = F.col("failure_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("bigint"))
    return F.when(failed.bitwiseAND(failed - 1) == 0, failed).otherwise(F.lit(0)).cast("bigint")


def ablations(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and that
    are kept when it alone is left out.  Counted from bit patterns, of which there
    are at most two to the number of rules; an empty ledger gives no rows."""
    whole = mask(policy, rules)
    chosen = [r for r in rules if r.name in policy.rules]
    patterns = rows.groupBy("failure_bits").agg(F.count("*").alias("n"))
    each = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in chosen])
    )
    bits, bit, n = F.col("failure_bits"), F.col("r.bit"), F.col("n")
    in_policy = bits.bitwiseAND(F.lit(whole).cast("bigint"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    return patterns.select("failure_bits", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        total(bits.bitwiseAND(bit) != 0).alias("failed"),
        total(in_policy == bit).alias("failed_alone"),
        total((in_policy == 0) | (in_policy == bit)).alias("kept_without"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
win AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
spelled AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS five FROM win),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM spelled),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM counted, range(5) r(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END
     + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
     + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failure_bits
  FROM m),
a AS (
  SELECT *, CASE WHEN failure_bits IN (1, 2, 4, 8, 16, 32) THEN failure_bits ELSE 0 END AS sole_failure FROM b)
SELECT *, failure_bits = 0 AS kept, 'strict-1' AS policy,
  CASE WHEN sole_failure > 0 THEN count(*) OVER (PARTITION BY sole_failure)
       + (SELECT count(*) FROM a WHERE failure_bits = 0) END AS kept_without
FROM a"""


@query("op8_rule_ledger", SQL)
def rule_ledger(spark, sf_dir):
    """Every document under the strict policy; where one rule alone rejects it,
    `sole_failure` is that rule's bit and `kept_without` the number of documents
    kept if that rule is left out."""
    # texts are read once: policy and ablations work on the stored bits
    rows = apply_policy(materialise(ledger(table(spark, sf_dir, "documents")), "rule-ledger"), STRICT)
    base = F.col("failure_bits").bitwiseAND(F.lit(mask(BASE)).cast("bigint")) != 0
    left_out = ablations(rows, STRICT).select(F.col("bit").alias("sole_failure"), "kept_without")
    # one row per rule
    return rows.select("*", base.alias("base_failed"), sole_failure(STRICT).alias("sole_failure")).join(F.broadcast(left_out), "sole_failure", "left")
