"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship
from workload.views import History, with_views

# row numbers and sizes are 32 bits wide in Spark and 64 in the oracle; results carry 64
WIDE = ("rank", "place", "position", "priority", "distance", "union", "shared", "index", "new_attempt")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(history) -> DataFrame`` under ``name``."""

    def keep(fn: Callable[[History], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark, "workload")
            return _widened(fn(History(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return fn

    return keep


def _widened(df: DataFrame) -> DataFrame:
    narrow = [f.name for f in df.schema.fields if f.name in WIDE and f.dataType.typeName() == "integer"]
    return df.withColumns({c: df[c].cast("bigint") for c in narrow}) if narrow else df
