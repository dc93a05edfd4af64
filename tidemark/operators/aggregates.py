"""Aggregates over run history.  All tenants in one job; group keys lead with the tenant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.stats import ms_between, nearest_rank, upper_median
from tidemark.operators import filters as flt
from tidemark.operators.joins import steps_of_runs
from tidemark.operators.skew import chunked_running_sum, ranked_values, top_n_per_group

WF = ["tenant_id", "workflow_name"]


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _window(runs: DataFrame, since: Column | None) -> DataFrame:
    out = flt.not_dry(runs)
    return out if since is None else out.where(F.col("created_at") >= since)


def workflow_run_stats(runs: DataFrame, since: Column | None = None) -> DataFrame:
    """Outcomes and cost per workflow."""
    s = F.col("status")
    return (
        _window(runs, since)
        .groupBy(*WF)
        .agg(
            F.count("*").alias("total"),
            _n(s == "succeeded").alias("succeeded"),
            _n(flt.is_failed(s)).alias("failed"),
            _n(s == "cancelled").alias("cancelled"),
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        )
    )


def step_stats(steps: DataFrame, runs: DataFrame, since: Column | None = None) -> DataFrame:
    """Behaviour of each step across the runs of its workflow."""
    s = F.col("status")
    return (
        steps_of_runs(steps, _window(runs, since))
        .groupBy(*WF, "step_id")
        .agg(
            _n(s.isin(*model.SEEN_STEP)).alias("seen"),
            _n(s == "succeeded").alias("succeeded"),
            _n(s == "failed").alias("failed"),
            _n(s == "skipped").alias("skipped"),
            _n(F.col("handled") == "continue").alias("ignored"),
            _n(F.col("attempt") > 1).alias("retried"),
            F.coalesce(F.sum("attempt"), F.lit(0)).cast("bigint").alias("attempts"),
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
            _n(F.col("compensation_status") == "done").alias("compensated"),
            _n(F.col("compensation_status") == "failed").alias("compensation_failed"),
        )
    )


def step_errors(steps: DataFrame, runs: DataFrame, since: Column | None = None) -> DataFrame:
    """Error codes behind failed steps.  Grouped on the raw code and class, named only for display."""
    j = steps_of_runs(steps.where(F.col("error").isNotNull()), _window(runs, since))
    g = j.groupBy(*WF, "step_id", F.col("error.code").alias("raw_code"), F.col("error.class").alias("raw_class")).agg(
        F.count("*").alias("n")
    )
    return g.select(
        *WF,
        "step_id",
        F.coalesce("raw_code", F.lit("UNKNOWN")).alias("code"),
        F.coalesce("raw_class", F.lit("unknown")).alias("error_class"),
        "n",
    )


def approval_stats(approvals: DataFrame, since: Column | None = None) -> DataFrame:
    """How approval gates behave, with the upper median of human decision times."""
    a = approvals if since is None else approvals.where(F.col("requested_at") >= since)
    # a gate with no workflow is its own group, told apart from one that is really called "unknown"
    a = a.withColumn("_wf", F.coalesce("workflow_name", F.lit("?"))).withColumn(
        "_ms",
        F.when(F.col("status").isin("approved", "denied"), ms_between(F.col("requested_at"), F.col("decided_at"))),
    )
    keys = ["tenant_id", "_wf", "step_id"]
    s = F.col("status")
    counts = a.groupBy(*keys).agg(
        F.count("*").alias("total"),
        _n(s == "approved").alias("approved"),
        _n(s == "denied").alias("denied"),
        _n(s == "timed-out").alias("timed_out"),
        _n(s == "pending").alias("pending"),
    )
    medians = ranked_values(a, keys, "_ms", {"median_decision_ms": upper_median()}).drop("n")
    shown = F.when(F.col("_wf") == "?", "unknown").otherwise(F.col("_wf")).alias("workflow_name")
    return counts.join(medians, keys, "left").select(
        "tenant_id", shown, "step_id", "total", "approved", "denied", "timed_out", "pending", "median_decision_ms"
    )


def runs_by_hour(runs: DataFrame, tenants: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Outcomes per hour and tenant over the last ``hours`` hours, empty hours included."""
    last = F.date_trunc("hour", as_of)
    first = last - F.expr(f"make_dt_interval(0, {hours - 1})")
    spine = tenants.select("tenant_id").distinct().select(
        "tenant_id", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("hour")
    )
    s = F.col("status")
    counts = (
        flt.not_dry(runs)
        .where((F.col("created_at") >= first) & (F.col("created_at") < last + F.expr("interval 1 hour")))
        .groupBy("tenant_id", F.date_trunc("hour", "created_at").alias("hour"))
        .agg(
            _n(s == "succeeded").alias("succeeded"),
            _n(flt.is_failed(s)).alias("failed"),
            _n(~(flt.is_failed(s) | (s == "succeeded"))).alias("other"),
        )
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("succeeded", "failed", "other")]
    return spine.join(counts, ["tenant_id", "hour"], "left").select("tenant_id", "hour", *zero)


def intervention_counts(runs: DataFrame, approvals: DataFrame, since: Column | None = None) -> DataFrame:
    """Runs, and runs that needed a person, per tenant."""
    r = _window(runs, since)
    total = r.groupBy("tenant_id").agg(F.count("*").alias("runs"))
    asked = approvals.select("tenant_id", "run_id").distinct()
    joined = asked.join(r.select(F.col("id").alias("run_id")), "run_id")
    some = joined.groupBy("tenant_id").agg(F.count("*").alias("with_approval"))
    return total.join(some, "tenant_id", "left").select(
        "tenant_id", "runs", F.coalesce("with_approval", F.lit(0)).alias("with_approval")
    )


def queue(runs: DataFrame) -> DataFrame:
    """Depth and oldest creation time of the queue; dry runs wait there too."""
    return (
        runs.where(F.col("status") == "queued")
        .groupBy("tenant_id")
        .agg(F.count("*").alias("depth"), F.min("created_at").alias("oldest_created_at"))
    )


def recent_outcomes(runs: DataFrame, since: Column) -> DataFrame:
    """Finished and failed runs per workflow, windowed on the finish time."""
    s = F.col("status")
    return (
        flt.not_dry(runs)
        .where((F.col("finished_at") >= since) & flt.is_finished(s))
        .groupBy(*WF)
        .agg(F.count("*").alias("finished"), _n(flt.is_failed(s)).alias("failed"))
    )


def stalled_runs(runs: DataFrame, steps: DataFrame, before: Column) -> DataFrame:
    """Running runs with no live step whose newest activity is older than ``before``."""
    from tidemark.operators.joins import last_activity, without_live_step

    running = flt.not_dry(runs).where(F.col("status") == "running")
    return last_activity(without_live_step(running, steps), steps).where(F.col("last_activity") < before)


def stale_approvals(approvals: DataFrame, before: Column) -> DataFrame:
    return approvals.where((F.col("status") == "pending") & (F.col("requested_at") < before)).select(
        "tenant_id", "id", "workflow_name", "step_id", "requested_at"
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def active_counts(runs: DataFrame, by_workflow: bool = True) -> DataFrame:
    keys = WF if by_workflow else ["tenant_id"]
    return runs.groupBy(*keys).agg(_n(flt.is_active(F.col("status"))).alias("active"))


def daily_cost(charges: DataFrame, at: str = "created_at") -> DataFrame:
    """Cost ledger: positive charges per tenant, workflow and UTC day."""
    return (
        charges.where(F.col("cost") > 0)
        .groupBy(*WF, F.to_date(at).alias("day"))
        .agg(F.sum("cost").alias("cost"))
    )


def add_to_ledger(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert that accumulates."""
    return ledger.unionByName(fresh).groupBy(*WF, "day").agg(F.sum("cost").alias("cost"))


def monthly_runs(runs: DataFrame, at: Column | None = None) -> DataFrame:
    """Non-dry runs per tenant and UTC calendar month, or only the month that contains ``at``."""
    r = flt.not_dry(runs)
    if at is not None:
        month = F.date_trunc("month", at)
        r = r.where((F.col("created_at") >= month) & (F.col("created_at") < F.add_months(month, 1)))
    return r.groupBy("tenant_id", F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias("used"))


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    return count_by(deliveries, "tenant_id", "status")


def outbox_stats(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("tenant_id").agg(
        _n(F.col("sent_at").isNull()).alias("pending"), _n(F.col("sent_at").isNotNull()).alias("sent")
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of a whole-number column, safe for groups of any size."""
    return ranked_values(df, keys, value, {k: nearest_rank(p) for k, p in points.items()})


def approx_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], accuracy: int = 10_000) -> DataFrame:
    """One-pass approximation of ``percentiles``, for callers who ask for it."""
    aggs = [F.percentile_approx(value, p / 100, accuracy).alias(k) for k, p in points.items()]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *aggs)


def upper_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return ranked_values(df, keys, value, {"median": upper_median()})


def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = model.DURATION_BUCKETS) -> DataFrame:
    """Cumulative buckets in one pass: one row per group and bound, ``+Inf`` last, with sum and count."""
    v = F.col(value)
    aggs = [_n(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("count"), F.sum(v).alias("sum"), *aggs)
    pairs = [F.struct(F.lit(_bound(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return wide.select(*keys, "count", "sum", F.inline(F.array(*pairs)))


def _bound(b: float) -> str:
    return f"{b:g}"


def map_outcome(items: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Outcome of fan-out steps: failed when failures exceed max(count, floor(percent * n / 100)).

    ``items``: run_id, step_id, index, ok, message.  ``tolerance``: step_id, tol_count, tol_percent.
    All failures stay in the item rows; the outcome keeps the first ten of each step, by position.
    """
    first = top_n_per_group(items.where(~F.col("ok")).select("run_id", "step_id", "index", "message"), ["run_id", "step_id"], [F.asc("index")], 10)
    first = first.groupBy("run_id", "step_id").agg(F.array_sort(F.collect_list(F.struct("index", "message"))).alias("first_failures"))
    g = items.groupBy("run_id", "step_id").agg(
        F.count("*").alias("n"),
        _n(~F.col("ok")).alias("failures"),
    )
    t = g.join(first, ["run_id", "step_id"], "left").join(tolerance, "step_id", "left")
    allowed = F.greatest(
        F.coalesce(F.col("tol_count"), F.lit(0)),
        F.floor(F.coalesce(F.col("tol_percent"), F.lit(0)) / 100 * F.col("n")),
    )
    t = t.withColumn("allowed", allowed.cast("bigint"))
    over = F.col("failures") > F.col("allowed")
    return t.select(
        "run_id",
        "step_id",
        "n",
        "failures",
        "allowed",
        F.when(over, "failed").otherwise("succeeded").alias("outcome"),
        F.when(over, "MAP_TOLERANCE_EXCEEDED").alias("code"),
        F.when(over, F.col("first_failures")[0]["index"]).alias("first_failed_index"),
        F.when(over, F.col("first_failures")).alias("first_failures"),
    )


def map_results(items: DataFrame, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Results of fan-out steps in the order of their items: one row per item with its place among all and among the failed ones.

    ``items`` as for ``map_outcome``; of items with one index the failed come first.  A step is cut into chunks of its
    indexes, so one of any length spreads over tasks; positions are given, so nothing is gathered into one array.
    """
    step = ["run_id", "step_id"]
    failed = F.when(F.col("ok"), 0).otherwise(1)
    ordered = items.withColumn("_at", F.col("index") * 2 + 1 - failed)
    placed = chunked_running_sum(ordered, step, "_at", F.lit(1), "place", rows_per_chunk)
    placed = chunked_running_sum(placed, step, "_at", failed, "failure", rows_per_chunk)
    return placed.withColumn("failure", F.when(~F.col("ok"), F.col("failure"))).drop("_at")


def parallel_join(dependencies: DataFrame) -> DataFrame:
    """Outcome of parallel joins over dependency states: run_id, step_id, mode, dep_status."""
    s = F.col("dep_status")
    terminal = s.isin(*model.TERMINAL_STEP)
    g = dependencies.groupBy("run_id", "step_id", "mode").agg(
        F.bool_or(s == "succeeded").alias("any_ok"), F.bool_and(terminal).alias("all_done"), F.count("*").alias("deps")
    )
    any_mode = F.col("mode") == "any"
    ready = F.when(any_mode, F.col("any_ok") | F.col("all_done")).otherwise(F.col("all_done"))
    failed = any_mode & F.col("all_done") & ~F.col("any_ok")
    verdict = F.when(~ready, "wait").when(failed, "PARALLEL_ALL_FAILED").otherwise("ready")
    return g.withColumn("verdict", verdict)


def live_gauges(runs: DataFrame, approvals: DataFrame, events: DataFrame, circuits: DataFrame | None = None) -> DataFrame:
    """Gauges at scrape time as (metric, labels, value)."""
    s = F.col("status")
    def gauge(df, name, value):
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("labels"), "value")

    out = (
        gauge(runs, "active_runs", _n(flt.is_active(s)))
        .unionByName(gauge(runs, "queue_depth", _n(s == "queued")))
        .unionByName(gauge(approvals, "approvals_pending", _n(s == "pending")))
        .unionByName(gauge(events, "event_log_events", F.count("*")))
    )
    if circuits is None:
        return out
    label = F.concat(F.lit('capability="'), F.col("capability"), F.lit('"'))
    is_open = F.when(F.col("state") == "closed", 0.0).otherwise(1.0)
    return out.unionByName(circuits.select(F.lit("circuit_open").alias("metric"), label.alias("labels"), is_open.alias("value")))
