"""Queries: alert conditions and the life of an alert."""

from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.operators import aggregates as ag
from tidemark.plans import alerts as al
from tidemark.operators import quality as ql
from workload.aggregates import A26, FAILED, FINISHED, STALLED, human_sql, pct_sql
from workload.ranking import LATEST_FAILED
from workload.registry import query
from workload.views import iso_sql, ts

AT = "2001-08-02 00:00:00"
# the bench runs are spread over years: a month-long look-back stands in for the half hour
CFG = al.AlertConfig(failure_window_ms=30 * 86_400_000, failure_rate=0.4, critical_rate=0.6)

L01 = f"""SELECT o.tenant_id, 'workflow-failing:' || o.workflow_name AS key, CASE WHEN failed / finished::DOUBLE >= 0.6 THEN 'critical' ELSE 'warning' END AS severity,
  o.workflow_name || ' is failing' AS title, failed || ' of ' || finished || ' runs failed in the last 720.0h (' || {pct_sql('failed / finished::DOUBLE')} || ').' || ' Latest error: ' || coalesce(l.code, 'null') || ' — ' || coalesce(l.message, 'null') AS message
FROM (SELECT tenant_id, workflow_name, count(*) AS finished, count(*) FILTER (status IN {FAILED}) AS failed FROM runs WHERE NOT dry_run AND status IN {FINISHED}
  AND finished_at >= TIMESTAMP '2001-07-03 00:00:00' GROUP BY 1, 2) o JOIN ({LATEST_FAILED}) l ON l.tenant_id = o.tenant_id AND l.workflow_name = o.workflow_name
WHERE finished >= 4 AND failed / finished::DOUBLE >= 0.4"""


@query("l01_workflow_failing", L01)
def l01(h):
    return al.workflow_failing(h.runs, ts(AT), CFG)


L02 = f"""SELECT tenant_id, 'approvals-waiting' AS key, 'warning' AS severity, n || ' approval' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' waiting too long' AS title,
  'The oldest, for ' || coalesce(workflow_name, 'a run') || ' › ' || step_id || ', has waited ' || {human_sql('(epoch_ms(TIMESTAMP ' + "'2001-08-02 00:00:00'" + ') - epoch_ms(requested_at))')} || '.' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY requested_at, id) AS rn, count(*) OVER (PARTITION BY tenant_id) AS n FROM approvals WHERE status = 'pending' AND requested_at < TIMESTAMP '2001-08-01 23:00:00') WHERE rn = 1"""


@query("l02_approvals_waiting", L02)
def l02(h):
    return al.approvals_waiting(h.approvals, ts(AT))


L03 = f"""SELECT tenant_id, 'runs-stalled:' || workflow_name AS key, 'critical' AS severity, workflow_name || ' has ' || n || ' stalled run' || CASE WHEN n = 1 THEN '' ELSE 's' END AS title,
  n || CASE WHEN n = 1 THEN ' run is' ELSE ' runs are' END || ' marked running, but no step moved for over 30.0min.' AS message FROM (SELECT tenant_id, workflow_name, count(*) AS n FROM ({STALLED}) GROUP BY 1, 2)"""


@query("l03_runs_stalled", L03)
def l03(h):
    return al.runs_stalled(h.runs, h.live_steps, ts(AT))


L04 = f"""SELECT tenant_id, 'queue-backlog' AS key, 'warning' AS severity, 'Runs are backing up' AS title, depth || CASE WHEN depth = 1 THEN ' run is' ELSE ' runs are' END || ' queued; the oldest has waited ' || {human_sql('age')} || '.' AS message
FROM (SELECT tenant_id, count(*) AS depth, epoch_ms(TIMESTAMP '2001-08-02 00:00:00') - epoch_ms(min(created_at)) AS age FROM runs WHERE status = 'queued' GROUP BY 1)"""


@query("l04_queue_backlog", L04)
def l04(h):
    return al.queue_backlog(h.runs, ts(AT))


CIRCUITS = """SELECT 'cap-' || (user_id % 12) AS capability, CASE WHEN count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-30 00:00:00') >= 5 THEN 'open' ELSE 'closed' END AS state FROM events GROUP BY 1"""


L05 = f"""SELECT 'default' AS tenant_id, 'circuit-open:' || capability AS key, 'warning' AS severity, 'Capability ' || capability || ' is failing fast' AS title,
  'The circuit of ' || capability || ' is open: its steps fail at once until calls succeed again.' AS message FROM ({CIRCUITS}) WHERE state <> 'closed'"""


def circuits(h):
    return h.raw("events").groupBy(F.expr("concat('cap-', user_id % 12)").alias("capability")).agg(
        F.expr("CASE WHEN count_if(event_type = 'error' AND ts >= timestamp_ntz'2024-01-30 00:00:00') >= 5 THEN 'open' ELSE 'closed' END").alias("state"))


@query("l05_circuit_open", L05)
def l05(h):
    return al.circuits_open(circuits(h))


VERIFY = """WITH e AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY tenant_id ORDER BY seq), 'genesis') AS want, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS rn FROM chained_events),
b AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS first FROM e WHERE prev_hash <> want)
SELECT t.tenant_id, b.seq IS NULL AS ok, coalesce(b.rn - 1, t.n) AS checked, b.seq AS broken_at_seq, CASE WHEN b.seq IS NOT NULL THEN 'chain link does not match the previous event' END AS reason
FROM (SELECT tenant_id, count(*) AS n FROM e GROUP BY 1) t LEFT JOIN b ON b.tenant_id = t.tenant_id AND b.first = 1"""


def content():
    return F.sha2(F.concat_ws("|", F.col("seq") - 1, "user_id", "event_type", "props"), 256)


def verified(h):
    return ql.verify_chain(h.chained_events, content_hash=content(), genesis="genesis", rows_per_chunk=100_000)


L06 = f"""SELECT tenant_id, 'audit-integrity' AS key, 'critical' AS severity, 'The audit log failed its integrity check' AS title,
 'The hash chain is broken at event ' || broken_at_seq || ': ' || reason || '. Treat it as a security incident.' AS message FROM ({VERIFY}) WHERE NOT ok"""


@query("l06_audit_integrity", L06)
def l06(h):
    return al.audit_integrity(verified(h))


def alert_events(h):
    data = "concat('{\"key\":\"k', user_id % 40, '\",\"severity\":\"', CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'warning' END, '\",\"title\":\"T', user_id % 40, '\"}')"
    return h.events.where("event_type IN ('error', 'purchase')").select(
        "seq", "tenant_id", "ts", F.expr("CASE event_type WHEN 'error' THEN 'alert.raised' ELSE 'alert.resolved' END").alias("type"), F.expr(data).alias("data"))


OPEN = """SELECT tenant_id, key, severity, title, ts FROM (SELECT *, 'k' || (user_id % 40) AS key, 'T' || (user_id % 40) AS title, CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity,
 row_number() OVER (PARTITION BY tenant_id, user_id % 40 ORDER BY seq DESC) AS rn FROM hist_events WHERE event_type IN ('error','purchase')) WHERE rn = 1 AND event_type = 'error'"""


@query("l07_open_alerts", f"SELECT tenant_id, key, severity, title, {iso_sql('ts')} AS raised_at FROM ({OPEN})")
def l07(h):
    return al.open_alerts(alert_events(h)).select("tenant_id", "key", "severity", "title", st.iso(F.col("raised_at")).alias("raised_at"))


@query(
    "l08_alert_history",
    f"SELECT tenant_id, seq, {iso_sql('ts')} AS at, CASE event_type WHEN 'error' THEN 'raised' ELSE 'resolved' END AS event, 'k' || (user_id % 40) AS key FROM hist_events WHERE event_type IN ('error','purchase')",
)
def l08(h):
    return al.alert_history(alert_events(h)).withColumn("at", st.iso(F.col("at")))


@query(
    "l09_alert_text",
    f"""SELECT tenant_id, key, '[' || CASE WHEN severity = 'critical' THEN 'STILL CRITICAL' ELSE 'STILL WARNING' END || '] ' || title || chr(10) || '' || chr(10) || '(tenant ' || tenant_id || ')' AS text FROM ({OPEN})""",
)
def l09(h):
    o = al.open_alerts(alert_events(h))
    return o.select("tenant_id", "key", al.alert_text(F.col("severity"), F.lit("reminder"), F.col("title"), F.col("message"), F.col("tenant_id")).alias("text"))


@query("k13_active_alerts", f"SELECT tenant_id, key, row_number() OVER (PARTITION BY tenant_id ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, ts, key) AS place FROM ({OPEN})")
def k13(h):
    from pyspark.sql import Window as W

    from tidemark.operators import ranking as rk

    o = rk.active_alerts(al.open_alerts(alert_events(h)))
    w = W.partitionBy("tenant_id").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "raised_at", "key")
    return o.select("tenant_id", "key", F.row_number().over(w).alias("place"))


ALL_ALERTS = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (L01, L02, L03, L04, L05, L06))


# with the circuits and the audit chain
@query("l10_evaluate_all", ALL_ALERTS)
@query("l11_evaluate_all_sources", ALL_ALERTS)
def l11(h):
    return al.evaluate(h.runs, h.live_steps, h.approvals, ts(AT), CFG, circuits(h), verified(h))


ALL_GAUGES = f"""SELECT * FROM ({A26}) UNION ALL SELECT 'circuit_open', 'capability="' || capability || '"', CASE WHEN state = 'closed' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM ({CIRCUITS})"""


@query("a26_live_gauges", ALL_GAUGES)
@query("a28_live_gauges_with_circuits", ALL_GAUGES)
def a28(h):
    return ag.live_gauges(h.runs, h.approvals, h.events, circuits(h))
