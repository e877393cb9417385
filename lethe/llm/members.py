"""Rows that can find a partner in a join, by a map of bits, so that the others need not move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 32_768  # bits of a value of `bitmap_construct_agg`
BITS = 16  # bits per key: one row in sixteen stays without a partner
PAGES = 4_096  # pages of a map at most, together 16 MB


def likely(rows: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """The rows of `rows` that have a partner in `keys` on the columns `by`, and a few others.

    It stands before a join, which decides.  The map is broadcast: 2 bytes per key,
    but `PAGES` pages at most.  With more keys it lets more rows pass and loses none.
    """
    pages = min(PAGES, 1 + keys.count() * BITS // PAGE)
    spot = F.pmod(F.xxhash64(*by), F.lit(pages * PAGE).cast("bigint"))
    page, bit = F.floor(spot / PAGE).alias("page"), (spot % PAGE).alias("bit")
    # a page is filled in one place, so no half-filled page is moved
    bits = keys.select(page, bit).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = rows.select("*", page, bit).join(F.broadcast(bits), "page")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*rows.columns)
