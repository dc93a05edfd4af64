"""Ranking, ordering and top-k over run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.stats import ms_between, nearest_rank
from tidemark.operators import filters as flt
from tidemark.operators.skew import newest_per_group, ranked_values, top_n_per_group

WF = ["tenant_id", "workflow_name"]


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def run_timings(runs: DataFrame, since: Column | None = None, cap: int | None = None) -> DataFrame:
    """Timing facts of all runs, or of the newest ``cap`` runs per tenant where a caller asks for that."""
    r = flt.not_dry(runs)
    r = r if since is None else r.where(F.col("created_at") >= since)
    r = r.select("tenant_id", "workflow_name", "id", "status", "trigger_type", "created_at", "started_at", "finished_at",
                 flt.scheduled_for().alias("scheduled_for"))
    return r if cap is None else newest_per_group(r, ["tenant_id"], "created_at", "id", cap).drop("rank")


def durations(timings: DataFrame) -> DataFrame:
    """Milliseconds from start to finish of finished runs."""
    ok = flt.is_finished(F.col("status")) & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    return timings.where(ok).withColumn("duration_ms", ms_between(F.col("started_at"), F.col("finished_at")))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """Tallies over the last ``n`` runs of each workflow, and its last run."""
    few = top_n_per_group(runs.select(*WF, "id", "status", "created_at"), WF, _newest(), n)
    s = F.col("status")
    return few.groupBy(*WF).agg(
        F.count("*").alias("total"),
        F.count_if(s == "succeeded").alias("succeeded"),
        F.count_if(flt.is_failed(s)).alias("failed"),
        F.min_by("id", "rank").alias("last_run"),
        F.min_by("status", "rank").alias("last_status"),
    )


def top_errors_per_step(errors: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent errors of each step; ties by code, then class."""
    return top_n_per_group(errors, [*WF, "step_id"], [F.desc("n"), F.asc("code"), F.asc("error_class")], n)


def top_error_text(errors: DataFrame, n: int = 3) -> DataFrame:
    """Top errors folded to one row per step: the first code and an array of all."""
    top = top_errors_per_step(errors, n)
    return top.groupBy(*WF, "step_id").agg(
        F.min_by("code", "rank").alias("top_code"),
        F.expr("transform(array_sort(collect_list(struct(rank, code, error_class, n))), e -> struct(e.code, e.error_class as class, e.n as count))").alias("top_errors"),
    )


def failing_steps(step_stats: DataFrame, errors: DataFrame, n: int = 10) -> DataFrame:
    """Per tenant, the steps that failed most, with their commonest error; ties by workflow, then step."""
    bad = step_stats.where("failed > 0").select(
        *WF, "step_id", "failed", (F.col("succeeded") + F.col("failed")).alias("executions")
    )
    top = top_n_per_group(bad, ["tenant_id"], [F.desc("failed"), F.asc("workflow_name"), F.asc("step_id")], n)
    code = errors.groupBy(*WF, "step_id").agg(
        F.min_by("code", F.struct(-F.col("n"), F.col("code"), F.col("error_class"))).alias("top_error")
    )
    return top.join(code, [*WF, "step_id"], "left")


def busiest_workflows(run_stats: DataFrame) -> DataFrame:
    return run_stats.orderBy("tenant_id", F.desc("total"), "workflow_name")


def latest_failures(runs: DataFrame) -> DataFrame:
    """The newest failed run of each workflow, dry runs included."""
    return (
        runs.where(flt.is_failed(F.col("status")))
        .groupBy(*WF)
        .agg(F.max_by(F.struct("id", "error"), F.struct("created_at", "id")).alias("last"))
        .select(*WF, F.col("last.id").alias("run_id"), F.col("last.error").alias("error"))
    )


def queue_waits(timings: DataFrame) -> DataFrame:
    return timings.where(F.col("started_at").isNotNull()).withColumn(
        "wait_ms", ms_between(F.col("created_at"), F.col("started_at"))
    )


def worst_waits(timings: DataFrame, n: int = 3, p: float = 95) -> DataFrame:
    """The ``n`` workflows of each tenant whose queue wait is longest at the given percentile."""
    p95 = ranked_values(queue_waits(timings), WF, "wait_ms", {"p95_ms": nearest_rank(p)}).drop("n")
    w = W.partitionBy("tenant_id").orderBy(F.desc("p95_ms"), "workflow_name")
    return p95.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def by_severity(findings: DataFrame) -> DataFrame:
    """Most severe first, then by key in locale order."""
    order = F.create_map(*[F.lit(x) for kv in model.SEVERITY_ORDER.items() for x in kv])
    return findings.orderBy("tenant_id", F.element_at(order, F.col("severity")), F.collate("key", "UNICODE"))


def compensation_order(steps: DataFrame, compensable: DataFrame) -> DataFrame:
    """Succeeded steps whose undo is still to run, latest completion first within each run.

    ``compensable``: workflow_name, step_id of steps that declare an undo.
    """
    todo = steps.where("status = 'succeeded' AND coalesce(compensation_status, 'pending') IN ('pending', 'running')")
    j = todo.join(compensable.distinct(), ["workflow_name", "step_id"])
    w = W.partitionBy("run_id").orderBy(F.desc(F.coalesce("completed_seq", F.lit(0))), "step_id")
    return j.select("run_id", "step_id", "completed_seq", F.row_number().over(w).alias("position"))


def admission_order(runs: DataFrame) -> DataFrame:
    """Queued runs in the order they would be admitted."""
    return runs.where(F.col("status") == "queued").orderBy("priority", "created_at", "id")


def capacity_report(runs: DataFrame, tenant_cap: int, workflow_cap: int) -> DataFrame:
    """Free slots, queue length and what could start now, per workflow under its tenant's cap.

    Counts only, so it does not order the queue of a hot tenant in one task.
    """
    s = F.col("status")
    wf = runs.groupBy(*WF).agg(
        F.count_if(flt.is_active(s)).alias("active"), F.count_if(s == "queued").alias("queued")
    )
    tenant = W.partitionBy("tenant_id")
    wf = wf.withColumn("tenant_active", F.sum("active").over(tenant)).withColumn("tenant_queued", F.sum("queued").over(tenant))
    room = F.greatest(F.lit(0), F.lit(workflow_cap) - F.col("active"))
    tenant_room = F.greatest(F.lit(0), F.lit(tenant_cap) - F.col("tenant_active"))
    return wf.withColumn("startable", F.least("queued", room, tenant_room)).withColumn("tenant_room", tenant_room)


def queue_positions(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Place of every queued run in its tenant's queue, or of the first ``n`` of each.

    A long queue is counted by (priority, hour) first; only the runs of one hour are ordered together.
    """
    q = runs.where(F.col("status") == "queued").select("tenant_id", "workflow_name", "id", "priority", "created_at")
    if n is not None:
        return top_n_per_group(q, ["tenant_id"], [F.asc("priority"), F.asc("created_at"), F.asc("id")], n, rank="position")
    q = q.withColumn("_hour", F.date_trunc("hour", "created_at"))
    keys = ["tenant_id", "priority", "_hour"]
    before = W.partitionBy("tenant_id").orderBy("priority", "_hour").rowsBetween(W.unboundedPreceding, -1)
    counts = q.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = counts.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("tenant_id").eqNullSafe(F.col("_q_tenant_id")) & F.col("priority").eqNullSafe(F.col("_q_priority")) & F.col("_hour").eqNullSafe(F.col("_q__hour"))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("created_at", "id"))
    placed = q.withColumn("_at", inside).join(counts, same)
    return placed.select("tenant_id", "workflow_name", "id", "priority", "created_at", (F.col("_before") + F.col("_at")).alias("position"))


def next_completion_seq(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg((F.coalesce(F.max("completed_seq"), F.lit(0)) + 1).alias("next_seq"))


def canary_verdicts(runs: DataFrame, settings: DataFrame, newest: int = 100, min_runs: int = 5, max_failure_rate: float = 0.3) -> DataFrame:
    """Roll-back verdict per canaried workflow.

    Takes the newest runs of the workflow first and only then keeps finished
    canary runs of the canary version.
    """
    few = top_n_per_group(runs.select(*WF, "id", "status", "canary", "workflow_version", "created_at"), WF, _newest(), newest)
    c = settings.where("canary_version IS NOT NULL AND canary_percent > 0").select(
        "tenant_id", F.col("name").alias("workflow_name"), "canary_version"
    )
    s = F.col("status")
    kept = few.join(c, WF).where(
        F.col("canary") & (F.col("workflow_version") == F.col("canary_version")) & flt.is_finished(s)
    )
    g = kept.groupBy(*WF, "canary_version").agg(F.count("*").alias("runs"), F.count_if(s != "succeeded").alias("failed"))
    bad = (F.col("runs") >= min_runs) & (F.col("failed") / F.col("runs") > max_failure_rate)
    return g.withColumn("roll_back", bad)


def canary_bucket(name: Column, key: Column) -> Column:
    """Stable bucket 0..99 of a routing key."""
    digest = F.sha2(F.concat(name, F.lit(":"), key), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def semver_key(version: Column) -> Column:
    """Sortable key of a semantic version: numbers by value, a prerelease before its release.

    Prerelease parts compare numerically when both are numbers; numbers sort before words.
    """
    core = F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)", 0)
    num = lambda i: F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)", i).try_cast("bigint")
    pre = F.regexp_extract(version, r"^v?\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    part = F.transform(
        F.split(pre, r"\."),
        lambda p: F.when(
            p.rlike(r"^\d+$"), F.struct(F.lit(0).alias("w"), p.try_cast("bigint").alias("n"), F.lit("").alias("s"))
        ).otherwise(F.struct(F.lit(1).alias("w"), F.lit(None).cast("bigint").alias("n"), p.alias("s"))),
    )
    return F.struct(
        (core != "").alias("valid"), num(1).alias("major"), num(2).alias("minor"), num(3).alias("patch"),
        (pre == "").alias("release"), part.alias("pre"),
    )


def workflow_catalog(versions: DataFrame) -> DataFrame:
    """Versions per workflow, last publication, and the highest published version."""
    key = semver_key(F.col("version"))
    return versions.groupBy("tenant_id", "name").agg(
        F.count("*").alias("versions"),
        F.max("published_at").alias("last_published_at"),
        F.max_by("version", F.when(F.col("status") == "published", key)).alias("latest"),
    )


def active_alerts(alerts: DataFrame) -> DataFrame:
    """Critical first, then the oldest."""
    return alerts.orderBy("tenant_id", F.when(F.col("severity") == "critical", 0).otherwise(1), "raised_at", "key")
