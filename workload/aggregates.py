"""Queries: aggregates and the dashboard."""

from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.operators import aggregates as ag
from tidemark.operators import ranking as rk
from tidemark.plans import overview as ov
from workload.registry import query
from workload.views import RUNS_AS_OF, ts

def as_of():
    return ts(RUNS_AS_OF)


def since():
    return ts("1997-06-24 00:00:00")


SINCE_SQL = "TIMESTAMP '1997-06-24 00:00:00'"
FAILED = "('failed','rolled-back','compensation-failed')"
FINISHED = "('succeeded','failed','rolled-back','compensation-failed')"


def r2(c: str) -> str:
    return f"floor({c} * 100.0 + 0.5) / 100.0"


def money(df, *cols):
    for c in cols:
        df = df.withColumn(c, st.half_up(F.col(c), 2))
    return df


RUN_STATS = f"""SELECT tenant_id, workflow_name, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status IN {FAILED}) AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
  {r2('coalesce(sum(cost), 0)')} AS cost
FROM runs WHERE NOT dry_run AND created_at >= {SINCE_SQL} GROUP BY 1, 2"""


@query("a01_workflow_run_stats", RUN_STATS)
def a01(h):
    return money(ag.workflow_run_stats(h.runs, since()), "cost")


STEP_STATS = f"""SELECT r.tenant_id, r.workflow_name, s.step_id,
  count(*) FILTER (s.status IN ('succeeded','failed','skipped')) AS seen, count(*) FILTER (s.status = 'succeeded') AS succeeded,
  count(*) FILTER (s.status = 'failed') AS failed, count(*) FILTER (s.status = 'skipped') AS skipped,
  count(*) FILTER (s.handled = 'continue') AS ignored, count(*) FILTER (s.attempt > 1) AS retried,
  CAST(sum(s.attempt) AS BIGINT) AS attempts, {r2('sum(s.cost)')} AS cost,
  count(*) FILTER (s.compensation_status = 'done') AS compensated, count(*) FILTER (s.compensation_status = 'failed') AS compensation_failed
FROM steps s JOIN runs r ON r.id = s.run_id WHERE NOT r.dry_run AND r.created_at >= {SINCE_SQL} GROUP BY 1, 2, 3"""


@query("a02_step_stats", STEP_STATS)
def a02(h):
    return money(ag.step_stats(h.steps, h.runs, since()), "cost")


STEP_ERRORS = f"""SELECT tenant_id, workflow_name, step_id, coalesce(code, 'UNKNOWN') AS code, coalesce(class, 'unknown') AS error_class, n FROM (
  SELECT r.tenant_id, r.workflow_name, s.step_id, s.error_code AS code, s.error_class AS class, count(*) AS n
  FROM steps s JOIN runs r ON r.id = s.run_id WHERE NOT r.dry_run AND r.created_at >= {SINCE_SQL} AND s.has_error GROUP BY 1, 2, 3, 4, 5)"""


@query("a03_step_errors", STEP_ERRORS)
def a03(h):
    return ag.step_errors(h.steps, h.runs, since())


APPROVAL_STATS = f"""SELECT g.tenant_id, CASE WHEN wf = '?' THEN 'unknown' ELSE wf END AS workflow_name, g.step_id, count(*) AS total,
  count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'denied') AS denied,
  count(*) FILTER (status = 'timed-out') AS timed_out, count(*) FILTER (status = 'pending') AS pending,
  max(ms) FILTER (rn = n // 2 + 1) AS median_decision_ms
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, wf, step_id ORDER BY ms NULLS LAST) AS rn,
        count(ms) OVER (PARTITION BY tenant_id, wf, step_id) AS n
      FROM (SELECT *, coalesce(workflow_name, '?') AS wf,
              CASE WHEN status IN ('approved','denied') THEN epoch_ms(decided_at) - epoch_ms(requested_at) END AS ms
            FROM approvals WHERE requested_at >= {SINCE_SQL})) g
GROUP BY 1, 2, 3"""


@query("a04_approval_stats", APPROVAL_STATS)
def a04(h):
    return ag.approval_stats(h.approvals, since())


@query(
    "a05_runs_by_hour",
    f"""WITH t AS (SELECT DISTINCT tenant_id FROM runs),
spine AS (SELECT tenant_id, hour FROM t, (SELECT unnest(generate_series(TIMESTAMP '2001-08-02 00:00:00' - to_hours(1439), TIMESTAMP '2001-08-02 00:00:00', INTERVAL 1 HOUR)) AS hour)),
c AS (SELECT tenant_id, date_trunc('hour', created_at) AS hour, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status IN {FAILED}) AS failed, count(*) FILTER (status <> 'succeeded' AND status NOT IN {FAILED}) AS other
  FROM runs WHERE NOT dry_run GROUP BY 1, 2)
SELECT s.tenant_id, strftime(s.hour, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS hour, coalesce(succeeded, 0) AS succeeded,
  coalesce(failed, 0) AS failed, coalesce(other, 0) AS other
FROM spine s LEFT JOIN c ON c.tenant_id = s.tenant_id AND c.hour = s.hour""",
)
def a05(h):
    out = ag.runs_by_hour(h.runs, h.runs, as_of(), 1440)
    return out.withColumn("hour", st.iso(F.col("hour")))


INTERVENTIONS = f"""SELECT r.tenant_id, count(*) AS runs, count(a.run_id) AS with_approval
FROM runs r LEFT JOIN (SELECT DISTINCT run_id FROM approvals) a ON a.run_id = r.id
WHERE NOT r.dry_run AND r.created_at >= {SINCE_SQL} GROUP BY 1"""


@query("a06_intervention_counts", INTERVENTIONS)
def a06(h):
    return ag.intervention_counts(h.runs, h.approvals, since())


@query(
    "a07_queue",
    "SELECT tenant_id, count(*) AS depth, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS oldest_created_at FROM runs WHERE status = 'queued' GROUP BY 1",
)
def a07(h):
    return ag.queue(h.runs).withColumn("oldest_created_at", st.iso(F.col("oldest_created_at")))


@query(
    "a08_recent_outcomes",
    f"""SELECT tenant_id, workflow_name, count(*) FILTER (status IN {FINISHED}) AS finished, count(*) FILTER (status IN {FAILED}) AS failed
FROM runs WHERE NOT dry_run AND finished_at >= {SINCE_SQL} GROUP BY 1, 2 HAVING count(*) FILTER (status IN {FINISHED}) > 0""",
)
def a08(h):
    return ag.recent_outcomes(h.runs, since())


STALLED = """WITH per_run AS (SELECT run_id, max(updated_at) AS touched, count(*) FILTER (updated_at IS NULL) AS untouched,
  count(*) FILTER (status = 'running' OR status = 'retry-wait' OR starts_with(status, 'waiting-')) AS live FROM live_steps GROUP BY run_id),
quiet AS (SELECT tenant_id, id, workflow_name, greatest(touched, CASE WHEN coalesce(untouched, 1) > 0 THEN coalesce(started_at, created_at) END) AS last
  FROM runs LEFT JOIN per_run ON run_id = id WHERE status = 'running' AND NOT dry_run AND coalesce(live, 0) = 0)
SELECT tenant_id, id, workflow_name, strftime(last, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_activity FROM quiet WHERE last < TIMESTAMP '2001-08-01 23:30:00'"""


@query("a09_stalled_runs", STALLED)
def a09(h):
    out = ag.stalled_runs(h.runs, h.live_steps, ts("2001-08-01 23:30:00"))
    return out.withColumn("last_activity", st.iso(F.col("last_activity")))


@query(
    "a10_stale_approvals",
    """SELECT tenant_id, id, workflow_name, step_id, strftime(requested_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS requested_at
FROM approvals WHERE status = 'pending' AND requested_at < TIMESTAMP '2001-08-01 23:00:00'""",
)
def a10(h):
    return ag.stale_approvals(h.approvals, ts("2001-08-01 23:00:00")).withColumn("requested_at", st.iso(F.col("requested_at")))


@query("a11_count_by_status", "SELECT tenant_id, status, count(*) AS n FROM runs GROUP BY 1, 2")
def a11(h):
    return ag.count_by(h.runs, "tenant_id", "status")


ACTIVE = "('running','waiting-approval','waiting-event','compensating')"


@query("a12_active_count", f"SELECT tenant_id, workflow_name, count(*) FILTER (status IN {ACTIVE}) AS active FROM runs GROUP BY 1, 2")
def a12(h):
    return ag.active_counts(h.runs)


@query(
    "a13_daily_cost",
    f"SELECT tenant_id, workflow_name, strftime(created_at, '%Y-%m-%d') AS day, {r2('sum(cost)')} AS cost FROM runs WHERE cost > 0 GROUP BY 1, 2, 3",
)
def a13(h):
    return money(ag.daily_cost(h.runs), "cost").withColumn("day", F.col("day").cast("string"))


@query(
    "a14_monthly_usage",
    "SELECT tenant_id, strftime(created_at, '%Y-%m-01') AS month, count(*) AS used FROM account_runs WHERE NOT dry_run GROUP BY 1, 2",
)
def a14(h):
    return ag.monthly_runs(h.account_runs).withColumn("month", F.col("month").cast("string"))


@query("a15_delivery_counts", "SELECT tenant_id, status, count(*) AS n FROM deliveries GROUP BY 1, 2")
def a15(h):
    return ag.delivery_counts(h.deliveries)


@query(
    "a15_outbox_stats",
    "SELECT tenant_id, count(*) FILTER (sent_at IS NULL) AS pending, count(*) FILTER (sent_at IS NOT NULL) AS sent FROM outbox GROUP BY 1",
)
def a15b(h):
    return ag.outbox_stats(h.outbox)


def rank_sql(p: float) -> str:
    return f"CAST(greatest(1, least(n, ceil({p / 100} * n))) AS BIGINT)"


DURATIONS = f"""SELECT tenant_id, workflow_name, epoch_ms(finished_at) - epoch_ms(started_at) AS ms FROM runs
WHERE NOT dry_run AND status IN {FINISHED} AND started_at IS NOT NULL AND finished_at IS NOT NULL"""


@query(
    "a16_duration_percentiles",
    f"""SELECT tenant_id, workflow_name, n, max(ms) FILTER (rn = {rank_sql(50)}) AS p50, max(ms) FILTER (rn = {rank_sql(95)}) AS p95,
  max(ms) FILTER (rn = {rank_sql(99)}) AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, workflow_name ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tenant_id, workflow_name) AS n FROM ({DURATIONS}))
GROUP BY 1, 2, 3""",
)
def a16(h):
    d = rk.durations(rk.run_timings(h.runs, cap=None))
    return ag.percentiles(d, ["tenant_id", "workflow_name"], "duration_ms", {"p50": 50, "p95": 95, "p99": 99})


@query(
    "a17_upper_median",
    f"""SELECT tenant_id, n, max(ms) FILTER (rn = n // 2 + 1) AS median
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tenant_id) AS n FROM ({DURATIONS})) GROUP BY 1, 2""",
)
def a17(h):
    return ag.upper_medians(rk.durations(rk.run_timings(h.runs, cap=None)), ["tenant_id"], "duration_ms")


def human_sql(ms: str) -> str:
    def t(unit, tag):
        n = f"CAST(floor({ms} / {unit} * 10 + 0.5) AS BIGINT)"
        return f"({n} // 10) || '.' || ({n} % 10) || '{tag}'"

    return (
        f"CASE WHEN {ms} < 1000 THEN CAST(floor({ms} + 0.5) AS BIGINT) || 'ms' WHEN {ms} < 60000 THEN {t('1000.0::DOUBLE', 's')} "
        f"WHEN {ms} < 3600000 THEN {t('60000.0::DOUBLE', 'min')} ELSE {t('3600000.0::DOUBLE', 'h')} END"
    )


def pct_sql(r: str) -> str:
    return f"CAST(floor(({r}) * 100 + 0.5) AS BIGINT) || '%'"


@query(
    "a18_ratio_texts",
    f"""SELECT tenant_id, workflow_name, CASE WHEN f = 0 THEN 0.0::DOUBLE ELSE b / f::DOUBLE END AS rate, {pct_sql('CASE WHEN f = 0 THEN 0.0::DOUBLE ELSE b / f::DOUBLE END')} AS rate_text,
  {human_sql('ms')} AS longest
FROM (SELECT tenant_id, workflow_name, count(*) FILTER (status IN {FINISHED}) AS f, count(*) FILTER (status IN {FAILED}) AS b,
   max(epoch_ms(finished_at) - epoch_ms(started_at)) AS ms FROM runs GROUP BY 1, 2)""",
)
def a18(h):
    from tidemark.operators import filters as flt

    g = h.runs.groupBy("tenant_id", "workflow_name").agg(
        F.count_if(flt.is_finished(F.col("status"))).alias("f"),
        F.count_if(flt.is_failed(F.col("status"))).alias("b"),
        F.max(st.ms_between(F.col("started_at"), F.col("finished_at"))).alias("ms"),
    )
    rate = st.ratio(F.col("b"), F.col("f"))
    return g.select("tenant_id", "workflow_name", rate.alias("rate"), st.pct_text(rate).alias("rate_text"), st.human_ms(F.col("ms")).alias("longest"))


@query(
    "a19_workflow_catalog",
    """WITH p AS (SELECT *, CAST(split_part(split_part(version, '-', 1), '.', 1) AS INT) AS ma, CAST(split_part(split_part(version, '-', 1), '.', 2) AS INT) AS mi,
  CAST(split_part(split_part(version, '-', 1), '.', 3) AS INT) AS pa, CASE WHEN version LIKE '%-rc.%' THEN 0 ELSE 1 END AS rel,
  CASE WHEN version LIKE '%-rc.%' THEN CAST(split_part(version, '-rc.', 2) AS INT) ELSE 0 END AS rc FROM versions)
SELECT a.tenant_id, a.name, a.versions, strftime(a.last, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_published_at, b.version AS latest
FROM (SELECT tenant_id, name, count(*) AS versions, max(published_at) AS last FROM p GROUP BY 1, 2) a
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY tenant_id, name ORDER BY ma DESC, mi DESC, pa DESC, rel DESC, rc DESC) AS rn FROM p WHERE status = 'published') b
ON a.tenant_id = b.tenant_id AND a.name = b.name AND b.rn = 1""",
)
def a19(h):
    return rk.workflow_catalog(h.versions).withColumn("last_published_at", st.iso(F.col("last_published_at")))


# ------------------------------------------------------------------ dashboard
@query(
    "a20_overview_totals",
    f"""WITH w AS (SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status IN {FAILED}) AS failed,
  count(*) FILTER (status = 'cancelled') AS cancelled, {r2('sum(cost)')} AS cost FROM runs WHERE NOT dry_run AND created_at >= {SINCE_SQL} GROUP BY 1),
a AS (SELECT tenant_id, count(*) FILTER (status IN {ACTIVE}) AS active, count(*) FILTER (status = 'queued') AS queued, min(created_at) FILTER (status = 'queued') AS oldest FROM runs GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rn FROM runs WHERE NOT dry_run AND created_at >= {SINCE_SQL}),
d AS (SELECT tenant_id, ms, row_number() OVER (PARTITION BY tenant_id ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tenant_id) AS n FROM
  (SELECT tenant_id, epoch_ms(finished_at) - epoch_ms(started_at) AS ms FROM t WHERE status IN {FINISHED})),
l AS (SELECT tenant_id, max(ms) FILTER (rn = {rank_sql(50)}) AS p50_ms, max(ms) FILTER (rn = {rank_sql(95)}) AS p95_ms FROM d GROUP BY 1),
i AS ({INTERVENTIONS}),
g AS ({APPROVAL_STATS}),
gm AS (SELECT tenant_id, max(m) FILTER (rn = {rank_sql(50)}) AS median_decision_ms FROM (SELECT tenant_id, median_decision_ms AS m,
  row_number() OVER (PARTITION BY tenant_id ORDER BY median_decision_ms) AS rn, count(*) OVER (PARTITION BY tenant_id) AS n FROM g WHERE median_decision_ms IS NOT NULL) GROUP BY 1),
p AS (SELECT tenant_id, count(*) FILTER (status = 'pending') AS pending FROM approvals GROUP BY 1)
SELECT a.tenant_id, total, succeeded, failed, cancelled, active, queued, succeeded / (succeeded + failed)::DOUBLE AS success_rate,
  p50_ms, p95_ms, with_approval / runs::DOUBLE AS manual_intervention_rate, coalesce(pending, 0) AS approvals_pending, median_decision_ms,
  epoch_ms(TIMESTAMP '2001-08-02 00:00:00') - epoch_ms(oldest) AS oldest_wait_ms, cost
FROM a LEFT JOIN w ON w.tenant_id = a.tenant_id LEFT JOIN l ON l.tenant_id = a.tenant_id LEFT JOIN i ON i.tenant_id = a.tenant_id
LEFT JOIN gm ON gm.tenant_id = a.tenant_id LEFT JOIN p ON p.tenant_id = a.tenant_id""",
)
def a20(h):
    return money(ov.totals(h.runs, h.approvals, as_of(), since=since()), "cost")


@query(
    "a20_overview_workflows",
    f"""WITH w AS ({RUN_STATS}),
t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rk FROM runs WHERE NOT dry_run AND created_at >= {SINCE_SQL}),
d AS (SELECT tenant_id, workflow_name, ms, row_number() OVER (PARTITION BY tenant_id, workflow_name ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tenant_id, workflow_name) AS n FROM
  (SELECT tenant_id, workflow_name, epoch_ms(finished_at) - epoch_ms(started_at) AS ms FROM t WHERE status IN {FINISHED})),
l AS (SELECT tenant_id, workflow_name, max(ms) FILTER (rn = {rank_sql(95)}) AS p95_ms FROM d GROUP BY 1, 2)
SELECT w.tenant_id, w.workflow_name, total, succeeded, failed, CASE WHEN succeeded + failed > 0 THEN succeeded / (succeeded + failed)::DOUBLE END AS success_rate, p95_ms, cost
FROM w LEFT JOIN l ON l.tenant_id = w.tenant_id AND l.workflow_name = w.workflow_name""",
)
def a20b(h):
    return money(ov.workflows(h.runs, since=since()), "cost")


FAILING_STEPS = f"""WITH s AS ({STEP_STATS}), e AS ({STEP_ERRORS})
SELECT f.tenant_id, f.workflow_name, f.step_id, f.failed, f.executions, f.rank, t.code AS top_error FROM (
  SELECT tenant_id, workflow_name, step_id, failed, succeeded + failed AS executions,
    row_number() OVER (PARTITION BY tenant_id ORDER BY failed DESC, workflow_name, step_id) AS rank FROM s WHERE failed > 0) f
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY tenant_id, workflow_name, step_id ORDER BY n DESC, code, error_class) AS rn FROM e) t
  ON t.tenant_id = f.tenant_id AND t.workflow_name = f.workflow_name AND t.step_id = f.step_id AND t.rn = 1
WHERE f.rank <= 10"""


@query("a20_overview_failing_steps", FAILING_STEPS)
def a20c(h):
    return ov.failing_steps(h.runs, h.steps, since=since())


@query(
    "a21_histogram",
    f"""WITH d AS (SELECT tenant_id, ms / 1000.0::DOUBLE AS sec FROM ({DURATIONS}))
SELECT tenant_id, count(*) AS count, sum(sec) AS sum, le, count(*) FILTER (sec <= bound) AS bucket
FROM d, (VALUES ('0.005', 0.005), ('0.025', 0.025), ('0.1', 0.1), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('10', 10), ('30', 30), ('120', 120), ('600', 600), ('3600', 3600), ('+Inf', 1e18)) b(le, bound)
GROUP BY tenant_id, le""",
)
def a21(h):
    d = rk.durations(rk.run_timings(h.runs, cap=None)).withColumn("sec", F.col("duration_ms") / 1000)
    return ag.histogram(d, ["tenant_id"], "sec")


@query(
    "a24_map_outcome",
    """WITH i AS (SELECT l_orderkey AS run_id, l_suppkey % 4 AS step, l_partkey * 10 + l_linenumber AS idx, l_returnflag <> 'R' AS ok FROM lineitem),
g AS (SELECT run_id, step, count(*) AS n, count(*) FILTER (NOT ok) AS failures, list_sort(list(idx) FILTER (NOT ok)) AS ff FROM i GROUP BY 1, 2),
t AS (SELECT *, greatest(CASE step WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END, CASE step WHEN 2 THEN CAST(floor(0.5 * n) AS BIGINT) ELSE 0 END) AS allowed FROM g)
SELECT CAST(run_id AS VARCHAR) AS run_id, 'm' || step AS step_id, n, failures, allowed, CASE WHEN failures > allowed THEN 'failed' ELSE 'succeeded' END AS outcome,
  CASE WHEN failures > allowed THEN 'MAP_TOLERANCE_EXCEEDED' END AS code, CASE WHEN failures > allowed THEN ff[1] END AS first_failed_index, CASE WHEN failures > allowed THEN array_to_string(ff[1:10], ',') END AS first_failed FROM t""",
)
def a24(h):
    tolerance = h.spark.createDataFrame([("m0", 1, None), ("m1", None, None), ("m2", None, 50.0)], "step_id string, tol_count int, tol_percent double")
    out = ag.map_outcome(map_items(h), tolerance)
    return out.withColumn("first_failed", F.array_join(F.col("first_failures.index").cast("array<string>"), ",")).drop("first_failures")


def map_items(h):
    return h.raw("lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.expr("concat('m', l_suppkey % 4)").alias("step_id"),
        F.expr("l_partkey * 10 + l_linenumber").alias("index"), (F.col("l_returnflag") != "R").alias("ok"), F.lit("item failed").alias("message"))


@query(
    "a24_map_results",
    """SELECT CAST(l_orderkey AS VARCHAR) AS run_id, 'm' || (l_suppkey % 4) AS step_id, l_partkey * 10 + l_linenumber AS "index", l_returnflag <> 'R' AS ok,
  row_number() OVER w AS place, CASE WHEN l_returnflag = 'R' THEN count(*) FILTER (l_returnflag = 'R') OVER w END AS failure
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY l_partkey * 10 + l_linenumber, l_returnflag <> 'R' ROWS UNBOUNDED PRECEDING)""",
)
def a24r(h):
    return ag.map_results(map_items(h)).drop("message")


@query(
    "a25_parallel_join",
    """WITH d AS (SELECT s.run_id, CASE WHEN s.k % 2 = 0 THEN 'any' ELSE 'all' END AS mode, s.status FROM live_steps s)
SELECT run_id, 'join' AS step_id, mode, bool_or(status = 'succeeded') AS any_ok, bool_and(status IN ('succeeded','failed','skipped','cancelled')) AS all_done, count(*) AS deps,
  CASE WHEN NOT (CASE WHEN mode = 'any' THEN bool_or(status = 'succeeded') OR bool_and(status IN ('succeeded','failed','skipped','cancelled')) ELSE bool_and(status IN ('succeeded','failed','skipped','cancelled')) END) THEN 'wait'
  WHEN mode = 'any' AND bool_and(status IN ('succeeded','failed','skipped','cancelled')) AND NOT bool_or(status = 'succeeded') THEN 'PARALLEL_ALL_FAILED' ELSE 'ready' END AS verdict
FROM d GROUP BY run_id, mode""",
)
def a25(h):
    d = h.live_steps.select("run_id", F.lit("join").alias("step_id"), F.expr("CASE WHEN cast(run_id as bigint) % 2 = 0 THEN 'any' ELSE 'all' END").alias("mode"), F.col("status").alias("dep_status"))
    return ag.parallel_join(d)


A26 = f"""SELECT 'active_runs' AS metric, '' AS labels, CAST(count(*) FILTER (status IN {ACTIVE}) AS DOUBLE) AS value FROM runs
UNION ALL SELECT 'queue_depth', '', CAST(count(*) FILTER (status = 'queued') AS DOUBLE) FROM runs
UNION ALL SELECT 'approvals_pending', '', CAST(count(*) FILTER (status = 'pending') AS DOUBLE) FROM approvals
UNION ALL SELECT 'event_log_events', '', CAST(count(*) AS DOUBLE) FROM events"""
