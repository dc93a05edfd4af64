"""Reading history tables and the filtered, paged lists over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import TABLE_DDL, schema_of


def read_history(spark: SparkSession, path: str, tables: Sequence[str] = tuple(TABLE_DDL), fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every table under ``path`` with its declared schema; nothing is inferred or read yet."""
    return {t: spark.read.schema(schema_of(t)).format(fmt).load(f"{path.rstrip('/')}/{t}") for t in tables}


def _where(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def filter_runs(
    runs: DataFrame,
    tenant: str | None = None,
    workflow: str | None = None,
    status: Sequence[str] = (),
    trigger_type: str | None = None,
    parent_run_id: str | None = None,
    since: Column | None = None,
    before: Column | None = None,
) -> DataFrame:
    """Runs that meet every given condition; an absent one does not filter."""
    c = F.col
    return _where(
        runs,
        [
            c("tenant_id") == tenant if tenant else None,
            c("workflow_name") == workflow if workflow else None,
            c("status").isin(*status) if status else None,
            c("trigger_type") == trigger_type if trigger_type else None,
            c("parent_run_id") == parent_run_id if parent_run_id else None,
            c("created_at") >= since if since is not None else None,
            c("created_at") < before if before is not None else None,
        ],
    )


def list_runs(runs: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page of runs, newest first, of the length asked for."""
    ordered = filter_runs(runs, **filters).orderBy(F.desc("created_at"), F.desc("id"))
    return ordered.offset(max(offset, 0)).limit(max(limit, 1))


def count_runs(runs: DataFrame, **filters) -> DataFrame:
    return filter_runs(runs, **filters).agg(F.count("*").alias("n"))


def list_events(
    events: DataFrame,
    tenant: str | None = None,
    run_id: str | None = None,
    step_id: str | None = None,
    types: Sequence[str] = (),
    after_seq: int | None = None,
    before_seq: int | None = None,
    order: str = "asc",
    limit: int = 500,
) -> DataFrame:
    """One page of events by sequence number, of the length asked for."""
    c = F.col
    kept = _where(
        events,
        [
            c("tenant_id") == tenant if tenant else None,
            c("run_id") == run_id if run_id else None,
            c("step_id") == step_id if step_id else None,
            c("type").isin(*types) if types else None,
            c("seq") > after_seq if after_seq is not None else None,
            c("seq") < before_seq if before_seq is not None else None,
        ],
    )
    return kept.orderBy(F.desc("seq") if order == "desc" else F.asc("seq")).limit(max(limit, 1))


def newest(df: DataFrame, ts: str, limit: int, equals: Mapping[str, str] | None = None, tie: str = "id") -> DataFrame:
    """Filtered list, newest first, capped: approvals, proposals, findings, changes, deliveries."""
    kept = _where(df, [F.col(k) == v for k, v in (equals or {}).items()])
    return kept.orderBy(F.desc(ts), F.desc(tie)).limit(limit)
