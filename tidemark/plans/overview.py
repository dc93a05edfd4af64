"""The dashboard: one lazy DataFrame per section, all tenants together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import nearest_rank, ratio_or_null
from tidemark.operators import aggregates as ag
from tidemark.operators import filters as flt
from tidemark.operators import ranking as rk
from tidemark.operators.skew import ranked_values

WF = ["tenant_id", "workflow_name"]


def look_back(as_of: Column, hours: int) -> Column:
    """Start of a window of at least an hour."""
    return as_of - F.expr(f"make_dt_interval(0, {max(1, hours)})")


def totals(runs: DataFrame, approvals: DataFrame, as_of: Column, hours: int = 24, since: Column | None = None) -> DataFrame:
    """The headline numbers per tenant.

    Active and queued count dry runs and ignore the window; everything else is
    windowed and without dry runs.  The approval median is the p50 of the gate medians.
    """
    since = look_back(as_of, hours) if since is None else since
    s = F.col("status")
    in_window = ~F.col("dry_run") & (F.col("created_at") >= since)
    # one pass over runs for everything that is a plain count
    base = runs.groupBy("tenant_id").agg(
        F.count_if(in_window).alias("_total"),
        F.count_if(in_window & (s == "succeeded")).alias("succeeded"),
        F.count_if(in_window & flt.is_failed(s)).alias("failed"),
        F.count_if(in_window & (s == "cancelled")).alias("cancelled"),
        F.sum(F.when(in_window, F.col("cost"))).alias("cost"),
        F.count_if(flt.is_active(s)).alias("active"),
        F.count_if(s == "queued").alias("queued"),
        F.min(F.when(s == "queued", F.col("created_at"))).alias("_oldest"),
    )
    d = rk.durations(rk.run_timings(runs, since))
    latency = ranked_values(d, ["tenant_id"], "duration_ms", {"p50_ms": nearest_rank(50), "p95_ms": nearest_rank(95)}).drop("n")
    people = ag.intervention_counts(runs, approvals, since)
    gates = ag.approval_stats(approvals, since)
    medians = _gate_median(gates)
    pending = approvals.groupBy("tenant_id").agg(F.count_if(s == "pending").alias("approvals_pending"))
    j = base
    for other in (latency, people, medians, pending):
        j = j.join(other, "tenant_id", "left")
    total = F.col("_total")
    return j.select(
        "tenant_id",
        total.alias("total"),
        "succeeded",
        "failed",
        "cancelled",
        "active",
        "queued",
        ratio_or_null(F.col("succeeded"), F.col("succeeded") + F.col("failed")).alias("success_rate"),
        "p50_ms",
        "p95_ms",
        ratio_or_null(F.col("with_approval"), F.col("runs")).alias("manual_intervention_rate"),
        F.coalesce("approvals_pending", F.lit(0)).alias("approvals_pending"),
        "median_decision_ms",
        (F.unix_millis(as_of) - F.unix_millis("_oldest")).alias("oldest_wait_ms"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
    )


def _gate_median(gates: DataFrame) -> DataFrame:
    g = gates.withColumnRenamed("median_decision_ms", "_gate_ms")
    return ranked_values(g, ["tenant_id"], "_gate_ms", {"median_decision_ms": nearest_rank(50)}).drop("n")


def hourly(runs: DataFrame, tenants: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return ag.runs_by_hour(runs, tenants, as_of, max(1, hours))


def workflows(runs: DataFrame, as_of: Column | None = None, hours: int = 24, since: Column | None = None) -> DataFrame:
    """Per workflow: runs, outcomes, success rate, p95 duration, cost."""
    since = look_back(as_of, hours) if since is None else since
    stats = ag.workflow_run_stats(runs, since)
    d = rk.durations(rk.run_timings(runs, since))
    p95 = ranked_values(d, WF, "duration_ms", {"p95_ms": nearest_rank(95)}).drop("n")
    return stats.join(p95, WF, "left").select(
        *WF, "total", "succeeded", "failed",
        ratio_or_null(F.col("succeeded"), F.col("succeeded") + F.col("failed")).alias("success_rate"),
        "p95_ms", "cost",
    )


def failing_steps(runs: DataFrame, steps: DataFrame, as_of: Column | None = None, hours: int = 24, since: Column | None = None) -> DataFrame:
    since = look_back(as_of, hours) if since is None else since
    return rk.failing_steps(ag.step_stats(steps, runs, since), ag.step_errors(steps, runs, since))


def overview(runs: DataFrame, steps: DataFrame, approvals: DataFrame, tenants: DataFrame, as_of: Column, hours: int = 24) -> dict[str, DataFrame]:
    """Every section by name."""
    return {
        "totals": totals(runs, approvals, as_of, hours),
        "hourly": hourly(runs, tenants, as_of, hours),
        "workflows": workflows(runs, as_of, hours),
        "failing_steps": failing_steps(runs, steps, as_of, hours),
    }
