"""Queries: ranking, top-k and ordering."""

from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.operators import aggregates as ag
from tidemark.operators import ranking as rk
from workload.aggregates import ACTIVE, FAILED, FAILING_STEPS, FINISHED, RUN_STATS, STEP_ERRORS, rank_sql, since
from workload.registry import query
from workload.views import iso_sql

SINCE = "TIMESTAMP '1997-06-24 00:00:00'"
TIMED = f"""SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rk FROM runs WHERE NOT dry_run AND created_at >= {SINCE}"""


@query(
    "k01_run_timings",
    f"""SELECT tenant_id, workflow_name, id, status, trigger_type, {iso_sql('created_at')} AS created_at, {iso_sql('started_at')} AS started_at,
  {iso_sql('finished_at')} AS finished_at, {iso_sql('scheduled_for')} AS scheduled_for
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rn FROM runs WHERE NOT dry_run AND created_at >= {SINCE})""",
)
def k01(h):
    t = rk.run_timings(h.runs, since())
    for c in ("created_at", "started_at", "finished_at", "scheduled_for"):
        t = t.withColumn(c, st.iso(F.col(c)))
    return t


@query(
    "k02_recent_runs",
    f"""SELECT tenant_id, workflow_name, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status IN {FAILED}) AS failed,
  max(id) FILTER (rn = 1) AS last_run, max(status) FILTER (rn = 1) AS last_status
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, workflow_name ORDER BY created_at DESC, id DESC) AS rn FROM runs) WHERE rn <= 20 GROUP BY 1, 2""",
)
def k02(h):
    return rk.recent_runs(h.runs, 20)


@query("k03_top_failing_steps", FAILING_STEPS)
def k03(h):
    return rk.failing_steps(ag.step_stats(h.steps, h.runs, since()), ag.step_errors(h.steps, h.runs, since()))


@query(
    "k04_busiest_workflows",
    f"SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total DESC, workflow_name) AS place FROM ({RUN_STATS})",
)
def k04(h):
    from pyspark.sql import Window as W

    b = rk.busiest_workflows(ag.workflow_run_stats(h.runs, since())).withColumn("cost", st.half_up(F.col("cost"), 2))
    return b.withColumn("place", F.row_number().over(W.partitionBy("tenant_id").orderBy(F.desc("total"), "workflow_name")))


LATEST_FAILED = f"""SELECT tenant_id, workflow_name, id AS run_id, error_code AS code, error_message AS message FROM
  (SELECT *, row_number() OVER (PARTITION BY tenant_id, workflow_name ORDER BY created_at DESC, id DESC) AS rn FROM runs WHERE status IN {FAILED}) WHERE rn = 1"""


@query("k05_latest_failed_run", LATEST_FAILED)
def k05(h):
    return rk.latest_failures(h.runs).select("tenant_id", "workflow_name", "run_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


TOP3 = f"""SELECT tenant_id, workflow_name, step_id, code, error_class, n, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY tenant_id, workflow_name, step_id ORDER BY n DESC, code, error_class) AS rank FROM ({STEP_ERRORS})) WHERE rank <= 3"""


@query("k06_top_errors_per_step", TOP3)
def k06(h):
    return rk.top_errors_per_step(ag.step_errors(h.steps, h.runs, since()))


WORST = f"""SELECT tenant_id, workflow_name, p95_ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY p95_ms DESC, workflow_name) AS rank FROM
  (SELECT tenant_id, workflow_name, max(ms) FILTER (rn = {rank_sql(95)}) AS p95_ms FROM
    (SELECT *, row_number() OVER (PARTITION BY tenant_id, workflow_name ORDER BY ms) AS rn, count(*) OVER (PARTITION BY tenant_id, workflow_name) AS n FROM
      (SELECT tenant_id, workflow_name, epoch_ms(started_at) - epoch_ms(created_at) AS ms FROM ({TIMED}) WHERE started_at IS NOT NULL)) GROUP BY 1, 2)) WHERE rank <= 3"""


@query("k07_worst_queue_waits", WORST)
def k07(h):
    return rk.worst_waits(rk.run_timings(h.runs, since()))


@query(
    "k09_compensation_order",
    """SELECT s.run_id, s.step_id, s.completed_seq, row_number() OVER (PARTITION BY s.run_id ORDER BY s.completed_seq DESC, s.step_id) AS position
FROM steps s JOIN runs r ON r.id = s.run_id WHERE s.status = 'succeeded' AND s.compensation_status IS NULL AND s.step_id IN ('s1','s2','s4','s6')""",
)
def k09(h):
    from tidemark.operators.joins import steps_of_runs

    undo = h.plan_steps.where("step_id IN ('s1','s2','s4','s6')").select(F.col("workflow").alias("workflow_name"), "step_id")
    return rk.compensation_order(steps_of_runs(h.steps, h.runs), undo)


@query(
    "k10_admission_order",
    f"SELECT tenant_id, id, priority, {iso_sql('created_at')} AS created_at FROM runs WHERE status = 'queued'",
)
def k10(h):
    return rk.admission_order(h.runs).select("tenant_id", "id", "priority", st.iso(F.col("created_at")).alias("created_at"))


@query(
    "k11_queue_positions",
    """SELECT tenant_id, workflow_name, id, priority, position FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY priority, created_at, id) AS position
FROM runs WHERE status = 'queued')""",
)
def k11(h):
    return rk.queue_positions(h.runs).drop("created_at")


@query(
    "k11_capacity_report",
    f"""WITH w AS (SELECT tenant_id, workflow_name, count(*) FILTER (status IN {ACTIVE}) AS active, count(*) FILTER (status = 'queued') AS queued FROM runs GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(active) OVER (PARTITION BY tenant_id) AS BIGINT) AS tenant_active, CAST(sum(queued) OVER (PARTITION BY tenant_id) AS BIGINT) AS tenant_queued FROM w)
SELECT *, least(queued, greatest(0, 200 - active), greatest(0, 800 - tenant_active)) AS startable, greatest(0, 800 - tenant_active) AS tenant_room FROM t""",
)
def k11b(h):
    return rk.capacity_report(h.runs, tenant_cap=800, workflow_cap=200)


@query("k12_next_completion_seq", "SELECT run_id, CAST(coalesce(max(completed_seq), 0) + 1 AS BIGINT) AS next_seq FROM steps GROUP BY 1")
def k12(h):
    return rk.next_completion_seq(h.steps)


@query(
    "k14_canary_verdicts",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, workflow_name ORDER BY created_at DESC, id DESC) AS rn FROM runs)
SELECT t.tenant_id, t.workflow_name, s.canary_version, count(*) AS runs, count(*) FILTER (status <> 'succeeded') AS failed,
  count(*) >= 5 AND count(*) FILTER (status <> 'succeeded') / count(*)::DOUBLE > 0.3 AS roll_back
FROM t JOIN settings s ON s.tenant_id = t.tenant_id AND s.name = t.workflow_name
WHERE rn <= 100 AND canary AND workflow_version = s.canary_version AND status IN {FINISHED} GROUP BY 1, 2, 3""",
)
def k14(h):
    return rk.canary_verdicts(h.runs, h.settings)


@query(
    "k15_canary_bucket",
    "SELECT id, CAST(CAST('0x' || substr(sha256(workflow_name || ':' || id), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM runs",
)
def k15(h):
    return h.runs.select("id", rk.canary_bucket(F.col("workflow_name"), F.col("id")).alias("bucket"))
