"""Queries: filters, predicates and row-level verdicts."""

from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.operators import filters as flt
from tidemark.operators.aggregates import count_by
from tidemark.plans import explain as ex
from workload.registry import query
from workload.views import iso_sql, ts

FAILED = "('failed','rolled-back','compensation-failed')"


@query("f01_not_dry", "SELECT tenant_id, count(*) AS n FROM runs WHERE NOT dry_run GROUP BY 1")
def f01(h):
    return count_by(flt.not_dry(h.runs), "tenant_id")


@query(
    "f02_status_sets",
    f"""SELECT status, status IN {FAILED} AS failed, status IN ('succeeded','failed','rolled-back','compensation-failed') AS finished,
  status IN ('succeeded','failed','rolled-back','compensation-failed','cancelled') AS terminal, status IN ('running','waiting-approval','waiting-event','compensating') AS active, count(*) AS n
FROM runs GROUP BY 1""",
)
def f02(h):
    s = F.col("status")
    return count_by(h.runs, "status").select(
        "status", flt.is_failed(s).alias("failed"), flt.is_finished(s).alias("finished"), flt.is_terminal(s).alias("terminal"), flt.is_active(s).alias("active"), "n")


@query("f03_tenant_isolation", "SELECT status, count(*) AS n FROM runs WHERE tenant_id = 'BUILDING' GROUP BY 1")
def f03(h):
    return count_by(flt.of_tenant(h.runs, "BUILDING"), "status")


@query(
    "f04_trailing_window",
    "SELECT tenant_id, count(*) AS n FROM runs WHERE created_at >= TIMESTAMP '2001-08-02 00:00:00' - to_days(30) GROUP BY 1",
)
def f04(h):
    return count_by(flt.trailing(h.runs, ts("2001-08-02 00:00:00"), 30), "tenant_id")


@query(
    "f05_payload_projection",
    f"SELECT id, error_code AS code, error_class AS class, {iso_sql('scheduled_for')} AS scheduled_for FROM runs",
)
def f05(h):
    return h.runs.select("id", F.col("error.code").alias("code"), F.col("error.class").alias("class"), st.iso(flt.scheduled_for()).alias("scheduled_for"))


@query(
    "f06_safe_path",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.no.such.path') AS missing FROM events",
)
def f06(h):
    p = F.col("props")
    return h.raw("events").select("event_id", flt.read_path(p, "k").alias("k"), flt.read_path(p, "no", "such", "path").alias("missing"))


@query(
    "f07_search_workflows",
    """WITH w AS (SELECT c_custkey, c_name AS name, c_mktsegment AS owner, c_acctbal < 0 AS killed, c_nationkey < 20 AS enabled FROM customer)
SELECT c_custkey, name, CASE WHEN killed THEN 'killed' WHEN enabled THEN 'enabled' ELSE 'disabled' END AS state FROM w
WHERE lower(name || ' ' || owner) LIKE '%#0%7%build%' AND NOT killed AND enabled""",
)
def f07(h):
    w = h.raw("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("owner"), F.expr("c_acctbal < 0").alias("killed"), F.expr("c_nationkey < 20").alias("enabled"))
    return flt.search_workflows(w, "#0*7*BUILD", state="enabled").select("c_custkey", "name", "state")


@query("f08_event_filter", "SELECT seq FROM hist_events WHERE value > 50 AND TRY_CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AND seq % 5 > 0")
def f08(h):
    return flt.where_passes(h.events, "value > 50 AND cast(get_json_object(data, '$.k') as int) % 2 = 0 AND (seq % 5 > 0 OR 10 / (seq % 5) > cast(event_type as int))").select("seq")


@query(
    "f09_expectations",
    """SELECT 'rows' AS "check", count(*) >= 1000 AS passed FROM orders UNION ALL SELECT 'no_null_price', count(*) FILTER (o_totalprice IS NULL) = 0 FROM orders
UNION ALL SELECT 'cheap', max(o_totalprice) < 1000 FROM orders""",
)
def f09(h):
    return flt.expect(h.raw("orders"), {"rows": "count(*) >= 1000", "no_null_price": "count_if(o_totalprice IS NULL) = 0", "cheap": "max(o_totalprice) < 1000"})


@query(
    "f10_mask_inputs",
    """SELECT c_custkey, '[REDACTED]' AS balance, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN '[REDACTED]' ELSE c_mktsegment END AS segment FROM customer""",
)
def f10(h):
    c = h.raw("customer")
    inputs = F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    sens = F.create_map(F.lit("balance"), F.lit("secret"), F.lit("segment"), F.when(F.col("c_nationkey") % 2 == 0, "confidential").otherwise("internal"))
    m = flt.mask_inputs(inputs, sens)
    return c.select("c_custkey", m["balance"].alias("balance"), m["name"].alias("name"), m["segment"].alias("segment"))


@query(
    "f11_invariants",
    """SELECT id, CASE WHEN NOT cost > 1000 THEN 'has-cost' WHEN CAST(id AS BIGINT) % 3 = 1 THEN 'plain' WHEN NOT coalesce(finished_at > started_at, false) THEN 'ended' WHEN dry_run THEN 'real' END AS violated FROM runs""",
)
def f11(h):
    checks = {"has-cost": "cost > 1000", "plain": "1 / (cast(id as bigint) % 3 - 1) < 5", "ended": "finished_at > started_at", "real": "NOT dry_run"}
    return flt.with_first_violation(h.runs, checks).select("id", "violated")


@query(
    "f12_first_match",
    """SELECT id, CASE WHEN cost > 300000 THEN 'large' WHEN coalesce(error_class = 'transient', false) THEN 'retry' WHEN status = 'succeeded' THEN 'done' ELSE 'BRANCH_NO_MATCH' END AS branch FROM runs""",
)
def f12(h):
    return h.runs.select("id", flt.first_match([("large", "cost > 300000"), ("retry", "error.class = 'transient'"), ("done", "status = 'succeeded'")]).alias("branch"))


DUE = f"""SELECT 'approval' AS kind, id FROM approvals WHERE status = 'pending' AND expires_at <= TIMESTAMP '2000-01-01 00:00:00'
UNION ALL SELECT 'delivery', id FROM deliveries WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT 'outbox', id FROM outbox WHERE sent_at IS NULL AND next_attempt_at <= TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT 'schedule', id FROM triggers WHERE type = 'schedule' AND enabled AND next_fire_at <= TIMESTAMP '2024-01-31 00:00:00'
UNION ALL SELECT 'timer', s.run_id || '/' || s.step_id FROM live_steps s JOIN runs r ON r.id = s.run_id WHERE s.status IN ('retry-wait','waiting-timer','waiting-event')
  AND s.wake_at <= TIMESTAMP '2000-01-01 00:00:00' AND r.status IN ('running','waiting-event','waiting-approval')"""


@query("f13_due", DUE)
def f13(h):
    def pick(kind, df):
        return df.select(F.lit(kind).alias("kind"), "id")

    late = ts("2024-01-20 00:00:00")
    timers = flt.due_steps(h.live_steps, h.runs, ts("2000-01-01 00:00:00"), limit=None)
    return (
        pick("approval", flt.due(h.approvals, "expires_at", ts("2000-01-01 00:00:00"), F.col("status") == "pending"))
        .unionByName(pick("delivery", flt.due(h.deliveries, "next_attempt_at", late, F.col("status") == "pending")))
        .unionByName(pick("outbox", flt.due(h.outbox, "next_attempt_at", late, F.col("sent_at").isNull())))
        .unionByName(pick("schedule", flt.due(h.triggers, "next_fire_at", ts("2024-01-31 00:00:00"), F.expr("type = 'schedule' AND enabled"))))
        .unionByName(pick("timer", timers.withColumn("id", F.concat_ws("/", "run_id", "step_id"))))
    )


@query(
    "f14_retry_verdict",
    """SELECT run_id, step_id, attempt < 3 AND error_class IN ('transient','contract') AND (error_class <> 'contract' OR attempt < 2) AS retry,
  CASE WHEN attempt >= 3 THEN 'attempts exhausted' WHEN error_class = 'business' THEN 'business failures are not retried'
   WHEN error_class = 'contract' AND attempt < 2 THEN 'contract failures get one retry' WHEN error_class = 'contract' THEN 'contract failure repeated' ELSE 'retryable' END AS reason
FROM steps WHERE has_error AND error_class IS NOT NULL""",
)
def f14(h):
    e = F.col("error")
    v = flt.retry_verdict(F.col("attempt"), F.lit(3), e["class"], e["retryable"], F.array(F.lit("transient")))
    s = h.steps.where("error.class IS NOT NULL").withColumn("v", v)
    return s.select("run_id", "step_id", "v.retry", "v.reason")


@query(
    "f15_backoff",
    """SELECT run_id, step_id, CAST(greatest(0, least(floor(least(1000 * pow(2.0::DOUBLE, greatest(0, attempt - 1)), 60000) * (1 + 0.2::DOUBLE * (2 * ((k % 100) / 100.0::DOUBLE) - 1)) + 0.5), 60000)) AS BIGINT) AS delay_ms,
  CAST(least(pow(2.0::DOUBLE, attempt) * 5000, 3600000) AS BIGINT) AS delivery_ms FROM steps""",
)
def f15(h):
    a = F.col("attempt")
    rnd = F.expr("cast(run_id as bigint) % 100 / 100.0D")
    return h.steps.select("run_id", "step_id", flt.backoff_ms(a, F.lit(1000), F.lit(60000), F.lit(0.2), rnd).alias("delay_ms"), flt.delivery_backoff_ms(a).alias("delivery_ms"))


@query("f16_outbox_kind", "SELECT type, CASE WHEN type = 'run.succeeded' THEN 'usage' END AS kind, count(*) AS n FROM hist_events GROUP BY 1")
def f16(h):
    return count_by(h.events, "type").withColumn("kind", flt.outbox_kind(F.col("type")))


@query(
    "f17_effective_plan",
    "SELECT tenant_id, CASE WHEN status IN ('active','trialing') AND plan IN ('pro','team') THEN plan ELSE 'free' END AS plan FROM billing_accounts",
)
def f17(h):
    return h.billing_accounts.select("tenant_id", flt.effective_plan(F.col("plan"), F.col("status")).alias("plan"))


@query(
    "f18_explain_runs",
    f"""WITH bad AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN handled IS NULL THEN 0 ELSE 1 END, n) AS rn FROM steps WHERE status = 'failed'),
x AS (SELECT r.*, b.step_id AS bad_step, CASE WHEN b.step_id IS NOT NULL THEN b.error_code ELSE r.error_code END AS c,
  CASE WHEN b.step_id IS NOT NULL THEN b.error_class ELSE r.error_class END AS cl, epoch_ms(r.finished_at) - epoch_ms(r.started_at) AS ms
  FROM runs r LEFT JOIN bad b ON b.run_id = r.id AND b.rn = 1)
SELECT id, CASE status WHEN 'succeeded' THEN 'Succeeded in ' || TOOK || '.' WHEN 'cancelled' THEN 'Cancelled before it finished.' WHEN 'queued' THEN 'Queued; it has not started yet.'
  WHEN 'running' THEN 'Running.' WHEN 'waiting-approval' THEN 'Paused, waiting for approval.' WHEN 'waiting-event' THEN 'Paused, waiting for an event.'
  WHEN 'rolled-back' THEN 'Failed at ' || coalesce('“' || bad_step || '”', '“a step”') || ' and was rolled back.'
  WHEN 'compensation-failed' THEN 'Failed at ' || coalesce('“' || bad_step || '”', '“a step”') || ' and the rollback did not complete — needs attention.'
  ELSE 'Failed at ' || coalesce('“' || bad_step || '”', '“a step”') || '.' END AS headline,
  CASE WHEN status IN {FAILED} THEN coalesce(c, 'UNKNOWN') END AS code, CASE WHEN status IN {FAILED} THEN coalesce(cl, 'unknown') END AS error_class
FROM x""".replace("TOOK", "(CASE WHEN ms < 60000 THEN (CAST(floor(ms / 1000.0::DOUBLE * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(ms / 1000.0::DOUBLE * 10 + 0.5) AS BIGINT) % 10) || 's' "
          "WHEN ms < 3600000 THEN (CAST(floor(ms / 60000.0::DOUBLE * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(ms / 60000.0::DOUBLE * 10 + 0.5) AS BIGINT) % 10) || 'min' "
          "ELSE (CAST(floor(ms / 3600000.0::DOUBLE * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(ms / 3600000.0::DOUBLE * 10 + 0.5) AS BIGINT) % 10) || 'h' END)"),
)
def f18(h):
    return ex.explain_runs(h.runs, h.steps).select("id", "headline", "code", "error_class")
