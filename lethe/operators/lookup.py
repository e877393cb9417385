"""Left joins to tables with one row per key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DEALS = 4096  # kinds of null keys


@dataclass
class Lookup:
    """Columns of `dim` (unique on `dim_key`) for the expression `key`.

    `names` renames the columns that are added.
    """

    dim: DataFrame
    dim_key: str
    key: Column
    names: dict[str, str] = field(default_factory=dict)

    def values(self) -> list[str]:
        return [c for c in self.dim.columns if c != self.dim_key]


def _dealt(key: Column, facts: DataFrame) -> Column:
    """The key as text; a null one, which finds nothing, as the hash of its row instead,
    marked so that it equals no key."""
    hashed = [c for c, kind in facts.dtypes if "map<" not in kind and kind != "variant"]
    return F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.concat(F.lit("-"), F.pmod(F.xxhash64(*hashed), F.lit(DEALS)).cast("string")))


def lookup(facts: DataFrame, *lookups: Lookup) -> DataFrame:
    """Add the dimension columns of every lookup to every fact.

    Plain equi-joins: Spark broadcasts a dimension by its size in bytes, and
    splits the partitions of a hot key at run time, as it may for the left side
    of a left join.  Rows with a null key are dealt over all partitions, as most
    may have one.  Keys are texts or whole numbers.  The facts are read once.
    """
    out = facts
    for i, one in enumerate(lookups):
        dim = one.dim.select(
            F.concat(F.lit("+"), F.col(one.dim_key).cast("string")).alias(f"_dim{i}"), F.struct(*[F.col(c).alias(one.names.get(c, c)) for c in one.values()]).alias(f"_found{i}")
        )
        out = out.withColumn(f"_key{i}", _dealt(one.key, facts)).join(dim, F.col(f"_key{i}") == F.col(f"_dim{i}"), "left")
    added = [F.col(f"_found{i}.{one.names.get(c, c)}") for i, one in enumerate(lookups) for c in one.values()]
    return out.select(*facts.columns, *added)
