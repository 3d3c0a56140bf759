"""Keyed merges of what was pulled into what is held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(held: DataFrame, pulled: DataFrame, key: list[str], complete: bool, known: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `held` after a pull, with `incomplete`: whether the row was held over because the pull did not say all.

    A complete pull decides alone: keys that it lacks go. One that is not may add rows and change them, but not delete. `known` (the key's first column)
    leaves out rows of others, pulled or held. Columns of `keep` (a cached value that the source may send as null) stay as held where the pull has null. Keys are unique on both sides.
    """
    columns = [c for c in pulled.columns if c not in key]
    new = pulled if known is None else pulled.join(known, key[0], "left_semi")
    old = held if known is None else held.join(known, key[0], "left_semi")
    both = new.withColumn("_new", F.lit(True)).join(old.select(*key, F.struct(*columns).alias("_old"), F.lit(True).alias("_held")), key, "full")
    pick = lambda c: F.when(F.col("_new"), F.coalesce(c, f"_old.{c}") if c in keep else F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c)
    out = both.select(*key, *map(pick, columns), F.col("_new").isNull().alias("incomplete"))
    return out.filter("NOT incomplete") if complete else out
