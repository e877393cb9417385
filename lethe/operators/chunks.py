"""Cutting a corpus into runs of equal token count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.operators.order import running_sums
from lethe.session import materialise


def chunk_corpus(
    docs: DataFrame,
    tokenizer,
    max_length: int,
    order: str,
    text: str = "text",
    separator_ids: Sequence[int] = (),
    per_document: bool = False,
) -> DataFrame:
    """(chunk_id, input_ids): all documents in `order`, joined and cut every
    `max_length` tokens; n // max_length + 1 chunks, so the last may be empty.

    Tokens are made once and stored.  Positions come from a running sum over
    (order, count) alone; every piece a document gives to a chunk is shuffled
    once, and a chunk holds at most `max_length` tokens.
    With `per_document` chunks stop at document borders and keep the order column.
    """
    ids = tokenizer.encode(F.col(text))
    tokens = docs.select(F.col(order).alias("_order"), ids.alias("_ids"))
    length = F.lit(max_length)
    if per_document:
        pieces = tokens.withColumn("_n", F.size("_ids")).select(
            F.col("_order").alias(order),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.floor(F.col("_n") / length).cast("int")),
                    lambda c: F.slice(F.col("_ids"), c * length + 1, length),
                )
            ).alias("chunk_id", "input_ids"),
        )
        return pieces

    sep = list(separator_ids)
    joined = F.concat(F.array(*[F.lit(i) for i in sep]).cast("array<int>"), F.col("_ids"))
    stored = materialise(
        tokens.select("_order", joined.alias("_ids")).withColumn("_n", F.size("_ids").cast("long")), "tokens"
    )
    starts = running_sums(stored.select("_order", "_n"), "_order", ["_n"]).select(
        "_order", (F.col("_n_before") - len(sep)).alias("_start")
    )
    # the first document has no separator before it: its start is negative there
    placed = stored.join(starts, "_order")
    first = F.greatest(F.col("_start"), F.lit(0))
    end = F.col("_start") + F.col("_n")
    offset = first - F.col("_start")
    pieces = F.transform(
        F.sequence(F.floor(first / length), F.floor((end - 1) / length)),
        lambda c: F.struct(
            c.alias("chunk_id"),
            F.slice(
                F.col("_ids"),
                (F.greatest(c * length, first) - F.col("_start") + 1).cast("int"),
                (F.least((c + 1) * length, end) - F.greatest(c * length, first)).cast("int"),
            ).alias("ids"),
        ),
    )
    cut = placed.where(F.col("_n") > offset).select("_order", F.explode(pieces).alias("p"))
    chunks = (
        cut.groupBy(F.col("p.chunk_id").alias("chunk_id"))
        .agg(F.sort_array(F.collect_list(F.struct("_order", "p.ids"))).alias("s"))
        .select("chunk_id", F.flatten("s.ids").alias("input_ids"))
    )
    total = stored.agg((F.coalesce(F.sum("_n"), F.lit(0)) - len(sep)).alias("t")).select(
        F.greatest("t", F.lit(0)).alias("t")
    )
    last_empty = total.where(F.col("t") % length == 0).select(
        F.floor(F.col("t") / length).cast("long").alias("chunk_id"), F.array().cast("array<int>").alias("input_ids")
    )
    return chunks.unionByName(last_empty)
