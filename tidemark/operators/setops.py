"""Set operations: bags, differences, insert-if-absent, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns by name."""
    return reduce(DataFrame.unionByName, parts)


def bag_overlap(bags: DataFrame, left: Column, right: Column, owner: str, item: str) -> DataFrame:
    """Shared and union size of two bags given as rows: the sum of the smaller and of the larger counts per item.

    Both bags are counted before the shuffle, so their size does not matter.
    """
    b = bags.groupBy(item).agg(F.count_if(C(owner) == left).alias("_l"), F.count_if(C(owner) == right).alias("_r"))
    return b.agg(F.coalesce(F.sum(F.least("_l", "_r")), F.lit(0)).alias("shared"), F.coalesce(F.sum(F.greatest("_l", "_r")), F.lit(0)).alias("union"))


def differing(a: DataFrame, b: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Keys present on both sides whose values differ (null counts as a value)."""
    j = a.select(*on, C(value).alias("_a")).join(b.select(*on, C(value).alias("_b")), list(on))
    return j.where(~C("_a").eqNullSafe(C("_b"))).select(*on).distinct()


def removed(existing: DataFrame, declared: DataFrame, on: Sequence[str]) -> DataFrame:
    """What exists and is no longer declared."""
    return existing.join(declared.select(*on).distinct(), list(on), "left_anti")


def insert_if_absent(fresh: DataFrame, stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """New rows whose key is not stored; the first of equals."""
    new = fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_last(old: DataFrame, fresh: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(fresh)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_sum(old: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Accumulating upsert."""
    return old.unionByName(fresh).groupBy(*keys).agg(F.sum(value).alias(value))
