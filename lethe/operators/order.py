"""Global order without a single partition.

Positions and running totals over a whole dataset are computed from buckets
that are a pure function of the order column, so a task that is run again
after an executor loss gives the same answer:

1. cut points of the order column (approximate quantiles, a short list);
2. totals per (group, bucket), pre-aggregated before the shuffle, turned into
   offsets;
3. one shuffle of the rows by (group, bucket) and a window inside each bucket.

Approximation only balances the buckets; results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.session import materialise

BUCKETS_PER_PARTITION = 4  # so that hashing buckets onto partitions comes out even
PLACE = ("file_path", "block_start", "row_in_block")


def bucket_count(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Increasing values that split `order` into runs of about equal size."""
    buckets = buckets or bucket_count(df)
    probabilities = [i / buckets for i in range(1, buckets)]
    values = df.select(F.col(order).cast("double").alias("v")).approxQuantile(
        "v", probabilities, 1.0 / (2 * buckets)
    )
    return sorted(set(values))


def with_bucket(df: DataFrame, order: str, cuts: Sequence[float], name: str = "_bucket") -> DataFrame:
    """Bucket number, non-decreasing in `order` (a binary search on the JVM)."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    key = f"{name}_key"
    keyed = df.withColumn(key, F.col(order).cast("double"))
    bucketed = Bucketizer(
        splits=splits, inputCol=key, outputCol=name, handleInvalid="keep"
    ).transform(keyed)
    # null sorts first, so it has the lowest bucket of its own
    return bucketed.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(-1))).drop(key)


def running_sums(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    group: Sequence[str] = (),
    totals: bool = False,
) -> DataFrame:
    """Add `<value>_before`: the sum of `value` over earlier rows of the group,
    and with `totals` also `<value>_total`: its sum over the whole group.

    `order` is numeric and unique within a group.  A group of any size is
    spread over the buckets.
    """
    group = list(group)
    bucketed = with_bucket(df, order, cut_points(df, order))
    keys = [*group, "_bucket"]
    sums = bucketed.groupBy(*keys).agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    partition = group or [F.lit(0)]
    earlier = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    added = [F.coalesce(F.sum(f"_total_{v}").over(earlier), F.lit(0)).alias(f"_offset_{v}") for v in values]
    if totals:
        # a group has at most one row per bucket here
        whole = Window.partitionBy(*partition)
        added += [F.sum(f"_total_{v}").over(whole).alias(f"{v}_total") for v in values]
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *added)
    if not group:
        # at most one row per bucket, and their number is a setting
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = bucketed.join(offsets, reduce(lambda a, b: a & b, same))
    for v in values:
        joined = joined.withColumn(
            f"{v}_before",
            F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_offset_{v}"),
        )
    return joined.drop("_bucket", *[f"_k_{k}" for k in keys], *[f"_offset_{v}" for v in values])


def dense_index(
    df: DataFrame, order: str, name: str = "index", group: Sequence[str] = ()
) -> DataFrame:
    """Dense 0..n-1 position in ascending `order` (unique numeric column)."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(counted, order, ["_one"], group)
    return ranked.withColumn(name, F.col("_one_before").cast("long")).drop("_one", "_one_before")


def placed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of a file scan with the place of every row: file, block of the file,
    row in the block.

    Row numbers only rise within one task, and a block is read by one task.
    """
    return df.select(
        *columns,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_in_block"),
    )


def index_by_place(rows: DataFrame, name: str = "index", group: Sequence[str] = ()) -> DataFrame:
    """Replace the place of rows by a dense 0..n-1 position in file order.

    `rows` are a whole scan, as `placed` gives it; files are in the order of their
    paths as text, or within `group`, whose columns depend on the file alone.
    Rows are stored once, since another scan may cut blocks elsewhere, and none
    moves to be numbered: a row's number in its block is a difference, and one row
    per block tells how many rows lie before it.  A scan that was filtered before
    it came here is an error.
    """
    group, block = list(group), ["file_path", "block_start"]
    stored = materialise(rows, "placed")
    counted = stored.groupBy(*group, *block).agg(
        F.count("*").alias("_n"), F.min("row_in_block").alias("_first"), F.max("row_in_block").alias("_last")
    )
    # blocks in ranges; which range a block is in stays as it is once it is stored
    ranges = materialise(counted.repartitionByRange(*block).withColumn("_range", F.spark_partition_id()), "blocks")
    sums = ranges.groupBy(*group, "_range").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_k_{c}") for c in [*group, "_range"]], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*group, "_range"]]
    whole = F.col("_last") - F.col("_first") + 1 == F.col("_n")
    before = F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_offset") - F.col("_first")
    starts = ranges.join(offsets, reduce(lambda a, b: a & b, same)).select(
        *[F.col(c).alias(f"_b_{c}") for c in block],
        F.when(whole, before).otherwise(F.raise_error(F.lit("rows of a block are missing"))).alias("_start"),
    )
    at = (F.col("file_path") == F.col("_b_file_path")) & (F.col("block_start") == F.col("_b_block_start"))
    numbered = stored.join(starts, at).withColumn(name, (F.col("_start") + F.col("row_in_block")).cast("long"))
    return numbered.drop("_start", *PLACE, *[f"_b_{c}" for c in block])


def rank_with_ties(df: DataFrame, value: str, key: str, name: str = "rank") -> DataFrame:
    """Dense 0..n-1 position ordered by (`value`, `key`).

    `value` may repeat without limit (a third of all rows may share one value);
    `key` is a unique numeric tie-break.  Rows are spread by value and key
    bucket, so no value is handled by a single task.
    """
    cuts = cut_points(df, key)
    bucketed = with_bucket(df, key, cuts, "_slot")
    slots = bucketed.groupBy(value, "_slot").agg(F.count("*").alias("_n"))
    per_value = slots.groupBy(value).agg(F.sum("_n").alias("_n_value"))
    starts = running_sums(per_value, value, ["_n_value"]).select(
        value, F.col("_n_value_before").alias("_start")
    )
    earlier = Window.partitionBy(value).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(starts.withColumnRenamed(value, "_v"), F.col(value).eqNullSafe(F.col("_v")))
        .select(
            F.col(value).alias("_k_value"), F.col("_slot").alias("_k_slot"), (F.col("_skip") + F.col("_start")).alias("_offset")
        )
    )
    inside = Window.partitionBy(value, "_slot").orderBy(key)
    same = F.col(value).eqNullSafe(F.col("_k_value")) & (F.col("_slot") == F.col("_k_slot"))
    return (
        bucketed.join(offsets, same)
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long"))
        .drop("_slot", "_offset", "_k_value", "_k_slot")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one smallest in `order`.

    An aggregate, not a window: repeats collapse on the map side, so a key that
    holds a third of all rows costs one row per task in the shuffle.
    """
    columns = df.columns
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in columns if c not in keys]
    packed = F.struct(
        *[c.alias(f"_o{i}") for i, c in enumerate(order_cols)],
        *[F.col(c).alias(c) for c in rest],
    )
    first = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return first.select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in columns]
    )
