"""Keyed writes as transformations: insert-or-ignore, update by key, replace by key, consolidation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """existing, and of new the first row of each key that existing lacks.

    As under a unique constraint, a key with a null equals no other: all such rows are inserted.
    """
    whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    fresh = first_per_key(new.where(whole), keys, order).join(existing.select(*keys), list(keys), "left_anti").unionByName(new.where(~whole))
    return existing.unionByName(fresh.select(existing.columns) if set(existing.columns) <= set(fresh.columns) else fresh, allowMissingColumns=True)


def update_by_key(existing: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], only_if: Column | None = None) -> DataFrame:
    """existing with columns taken from updates where a row of the key is there (and only_if holds); one update per key."""
    marked = updates if only_if is None else updates.where(only_if)
    renamed = marked.select(*keys, F.lit(True).alias("__there"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = existing.join(renamed, list(keys), "left")
    return joined.select(*(F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new, and the rows of existing whose key new doesn't have: keys without new rows keep their old ones."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def consolidated(parts: Sequence[DataFrame | None], keys: Sequence[str]) -> DataFrame:
    """Rows of all parts that are there; of a key the row of the earliest part stays."""
    there = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts) if p is not None]
    whole = there[0]
    for p in there[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in (*keys, "__part")]
    return first_per_key(whole, keys, ["__part", *rest]).drop("__part")
