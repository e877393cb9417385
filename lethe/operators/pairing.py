"""Random but repeatable pairings of rows.

A choice is a hash of the row's index with seed and epoch, so a task that is
run again chooses the same partner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def choice(index: Column, n: Column, seed: int = 0, epoch: int = 0) -> Column:
    """A number from 0 to n-1: 60 bits of an MD5 over index, seed and epoch."""
    text = F.concat_ws(":", index.cast("string"), F.lit(str(seed)), F.lit(str(epoch)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n


def pick_answer(answers: Column, index: Column, seed: int = 0) -> Column:
    """One answer of a list; "" for an empty list or null."""
    n = F.greatest(F.size(F.coalesce(answers, F.array())), F.lit(1))
    return F.coalesce(F.get(answers, choice(index, n, seed).cast("int")), F.lit(""))


def partner_join(
    anchor: DataFrame,
    other: DataFrame,
    columns: Sequence[str],
    prefix: str,
    seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """Each anchor row with one row of `other`, chosen with replacement.

    `other` has a dense `index`.  Without rows in `other` the added columns are
    null.
    """
    chosen = anchor.withColumn("_size", other.agg(F.count("*")).scalar()).withColumn(
        "_partner", F.when(F.col("_size") > 0, choice(F.col("index"), F.greatest("_size", F.lit(1)), seed, epoch))
    )
    # a choice is a uniform hash, so no partner is hot
    dim = other.select(F.col("index").alias("_partner"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return chosen.join(dim, "_partner", "left").select(*anchor.columns, *[f"{prefix}{c}" for c in columns])


def forget_retain(
    forget: DataFrame | None,
    retain: DataFrame | None,
    columns: Sequence[str],
    anchor: str = "forget",
    seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """(index, role, columns...): each anchor row and its random partner.

    Rows of one pair share the anchor's index.  With no other set only the
    anchor rows come back.
    """
    sides = {"forget": forget, "retain": retain}
    if anchor not in sides:
        raise ValueError(f"anchor {anchor!r} is neither forget nor retain")
    base = sides.pop(anchor)
    if base is None:
        raise ValueError(f"the {anchor} set is missing while it is the anchor")
    (other_role, other), = sides.items()
    own = base.select("index", F.lit(anchor).alias("role"), *columns)
    if other is None:
        return own
    keys = [c for c in columns if c != "index"]
    paired = partner_join(base.select("index", *keys), other, ["index", *keys], "_p_", seed, epoch)
    roles = F.array(
        F.struct(F.lit(anchor).alias("role"), F.col("index").alias("row_index"), *[F.col(c).alias(c) for c in keys]),
        F.struct(F.lit(other_role).alias("role"), F.col("_p_index").alias("row_index"), *[F.col(f"_p_{c}").alias(c) for c in keys]),
    )
    long = paired.select("index", F.explode(roles).alias("r")).select("index", "r.*")
    return long.where(F.col("row_index").isNotNull())


def idk_pair(df: DataFrame, pool: DataFrame, answer: str = "answer", return_original: bool = True, seed: int = 0) -> DataFrame:
    """(…, variant, answer): each row with its answer and with a random refusal.

    `pool` has a dense `index` and `response`.
    """
    paired = partner_join(df, pool, ["response"], "_", seed)
    return _variants(paired, answer, F.col("_response"), return_original).drop("_response")


def alternate_pair(df: DataFrame, alternate: str, answer: str = "answer", return_original: bool = True) -> DataFrame:
    """(…, variant, answer): each row with its answer and with its alternate."""
    return _variants(df, answer, F.col(alternate), return_original)


def _variants(df: DataFrame, answer: str, alternate: Column, both: bool) -> DataFrame:
    made = [("original", F.col(answer))] if both else []
    made.append(("alternate", alternate))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), a.alias("a")) for v, a in made]))
    rest = [c for c in df.columns if c != answer]
    return df.select(*rest, F.col(answer), each.alias("_v")).select(
        *rest, F.col("_v.variant").alias("variant"), F.col("_v.a").alias(answer)
    )
