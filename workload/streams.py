"""Queries: streaming jobs run to the end of their source, and the sequential rules over history."""

from pyspark.sql import functions as F

from tidemark.functions import cron
from tidemark.functions import stats as st
from tidemark.operators import ranking as rk
from tidemark.plans import alerts as al
from tidemark.streaming import operators as so
from tidemark.streaming import runtime as rt
from tidemark.streaming import stateful as sf
from workload.alerts import CFG, L01, L02, L03, L04
from workload.registry import query
from workload.views import history_events, iso_sql, ts

C = F.col


def stream(h):
    return history_events(h.raw_stream("events"))


BUCKETS = (0.005, 0.025, 0.1, 0.5, 1.0, 2.5, 10.0, 30.0, 120.0, 600.0, 3600.0)


def b_sql(sec):
    return ", ".join(f"count(*) FILTER ({sec} <= {b}) AS b{i}" for i, b in enumerate(BUCKETS))


METRICS = f"""WITH m AS (SELECT 'runs_total' AS metric, 'status="succeeded",workflow="unknown"' AS labels, CAST(NULL AS DOUBLE) AS sec FROM hist_events WHERE type = 'run.succeeded'
UNION ALL SELECT 'run_duration_seconds', 'workflow="unknown"', value / 1000 FROM hist_events WHERE type = 'run.succeeded'
UNION ALL SELECT 'steps_total', 'outcome="succeeded"', NULL FROM hist_events WHERE type = 'step.succeeded'
UNION ALL SELECT 'step_duration_seconds', '', value / 1000 FROM hist_events WHERE type = 'step.succeeded'
UNION ALL SELECT 'steps_total', 'class="unknown",outcome="failed"', NULL FROM hist_events WHERE type = 'step.failed')
SELECT metric, labels, count(*) AS count, floor(sum(sec) * 10000.0 + 0.5) / 10000.0 AS sum, {b_sql('sec')} FROM m GROUP BY 1, 2"""


@query("t01_metrics_stream", METRICS)
def t01(h):
    out = rt.run_available(so.metrics(stream(h)), "metrics", mode="update")
    return rt.newest_per_key(out, ["metric", "labels"]).withColumn("sum", st.half_up(C("sum"), 4))


@query("t01_metrics_batch", METRICS)
def t01b(h):
    return so.metrics(h.events).withColumn("sum", st.half_up(C("sum"), 4))


@query("t02_fire_once", "SELECT DISTINCT 'trg-' || (user_id % 20) AS trigger_id, event_type || ':' || json_extract_string(props, '$.k') AS fire_key FROM events")
def t02(h):
    f = stream(h).select("ts", F.expr("concat('trg-', user_id % 20)").alias("trigger_id"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("fire_key"))
    return rt.run_available(so.fire_once(f), "fires").select("trigger_id", "fire_key")


@query("t03_fresh_deliveries", "SELECT tenant_id, count(DISTINCT (user_id, seq)) AS n FROM hist_events WHERE seq % 7 < 5 GROUP BY 1")
def t03(h):
    e = stream(h)
    doubled = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))  # every delivery arrives twice
    d = doubled.select("tenant_id", C("ts").alias("received_at"), (C("ts") - F.expr("make_dt_interval(0, 0, seq % 7 + 1)")).alias("sent_at"),
                       C("user_id").cast("string").alias("trigger_id"), C("seq").cast("string").alias("nonce"))
    return rt.run_available(so.fresh_deliveries(d), "nonces").groupBy("tenant_id").agg(F.count("*").alias("n"))


def requests(h):
    return h.events.select("seq", "tenant_id", F.lit("wf").alias("workflow_name"), C("user_id").cast("string").alias("dedup_key"), F.unix_millis("ts").alias("ms"), (C("event_type") == "error").alias("cancelled"))


HOURS_12 = 12 * 3_600_000
DEDUP = f"""WITH RECURSIVE r AS (SELECT seq, tenant_id, run_id AS k, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS cancelled FROM hist_events),
a AS (SELECT tenant_id, k, min(ms) AS at FROM r WHERE NOT cancelled GROUP BY 1, 2 UNION ALL
  SELECT a.tenant_id, a.k, (SELECT min(r.ms) FROM r WHERE r.k = a.k AND NOT r.cancelled AND r.ms > a.at + {HOURS_12}) FROM a WHERE a.at IS NOT NULL)
SELECT r.seq, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.k = r.k AND a.at IS NOT NULL AND r.ms > a.at AND r.ms <= a.at + {HOURS_12}) THEN 'deduplicated' ELSE 'accepted' END AS status FROM r"""


@query("t04_dedup_requests", DEDUP)
def t04(h):
    return sf.dedup_requests(requests(h), HOURS_12, rows_per_chunk=100_000).select("seq", "status")


@query("t04_dedup_requests_stream", DEDUP)
def t04s(h):
    e = stream(h)
    r = e.select("seq", "tenant_id", C("user_id").cast("string").alias("dedup_key"), F.unix_millis("ts").alias("ms"), (C("event_type") == "error").alias("cancelled"))
    out = sf.on_stream(r, ["tenant_id", "dedup_key"], ["ms", "seq"], lambda: sf.DedupWindow(HOURS_12), sf.DedupWindow.fields)
    return rt.run_available(out, "dedup").select("seq", "status")


def waits_of(e):
    w = e.where("event_type = 'signup'")
    return w.select("tenant_id", "run_id", C("seq").cast("string").alias("step_id"), F.lit("run.succeeded").alias("wait_event"),
                    F.expr("CASE WHEN seq % 3 > 0 THEN cast(user_id % 10 as string) END").alias("wait_correlation"), "ts", (C("ts") + F.expr("make_dt_interval(0, 6)")).alias("wake_at"))


def arrivals_of(e):
    return e.where("event_type = 'purchase'").select("tenant_id", "type", F.expr("cast(user_id % 10 as string)").alias("correlation"), "ts", "seq")


WAITS = """WITH w AS (SELECT *, CASE WHEN seq % 3 > 0 THEN user_id % 10 END AS corr FROM hist_events WHERE event_type = 'signup'), e AS (SELECT * FROM hist_events WHERE event_type = 'purchase')
SELECT w.seq AS wait_seq, min(e.seq) AS seq, CASE WHEN min(e.seq) IS NULL THEN 'WAIT_TIMEOUT' ELSE 'resumed' END AS outcome
FROM w LEFT JOIN e ON e.tenant_id = w.tenant_id AND (w.corr IS NULL OR w.corr = e.user_id % 10) AND e.ts >= w.ts AND e.ts <= w.ts + to_hours(6) GROUP BY 1"""


@query("t05_waits_with_timeout", WAITS)
def t05(h):
    m = so.waits_with_timeout(waits_of(h.events), arrivals_of(h.events))
    return m.select(C("step_id").cast("bigint").alias("wait_seq"), "seq", "outcome")


@query("t05_waits_stream", WAITS)
def t05s(h):
    rows = so.offers(waits_of(h.events), arrivals_of(h.events))
    # a last row later than every deadline moves the watermark past them
    closing = rows.agg(F.max("ts").alias("m")).select(
        F.lit("").alias("tenant_id"), F.lit("").alias("wait_event"), F.lit(True).alias("any"), F.lit("").alias("corr"), (C("m") + F.expr("interval 2 days")).alias("ts"),
        F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("wake_us"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("step_id"))
    out = rt.run_available(so.waits_stream(rt.replayed(rows, "ts", "offers", closing=closing)), "waits")
    return out.select(C("step_id").cast("bigint").alias("wait_seq"), "seq", "outcome")


EXPIRE = f"""SELECT tenant_id, id, CASE WHEN on_timeout = 'escalate' AND NOT escalated THEN 'escalate' WHEN on_timeout = 'approve' THEN 'approve' ELSE 'time-out' END AS action,
  CASE WHEN on_timeout = 'escalate' AND NOT escalated THEN 'pending' WHEN on_timeout = 'approve' THEN 'approved' ELSE 'timed-out' END AS new_status,
  CASE WHEN on_timeout = 'escalate' AND NOT escalated THEN '2000-01-01T01:00:00.000Z' END AS new_expires_at,
  CASE WHEN on_timeout = 'escalate' AND NOT escalated THEN NULL WHEN on_timeout = 'approve' THEN 'approved' ELSE 'denied' END AS outcome
FROM approvals WHERE status = 'pending' AND expires_at <= TIMESTAMP '2000-01-01 00:00:00'"""


@query("t06_expire_approvals", EXPIRE)
def t06(h):
    e = sf.expire_approvals(h.approvals, ts("2000-01-01 00:00:00"))
    return e.withColumn("new_expires_at", st.iso(C("new_expires_at")))


TIMERS = """WITH p AS (SELECT tenant_id, id, on_timeout, escalated, epoch_us(requested_at) // 1000 AS asked, epoch_us(expires_at) // 1000 AS due FROM approvals WHERE status = 'pending')
SELECT tenant_id, id, CASE WHEN on_timeout = 'escalate' AND NOT escalated THEN 'escalate' WHEN on_timeout = 'approve' THEN 'approve' ELSE 'time-out' END AS action, due AS at_ms FROM p
UNION ALL SELECT tenant_id, id, 'time-out', due + (due - asked) FROM p WHERE on_timeout = 'escalate' AND NOT escalated"""


@query("t06_approval_timers", TIMERS)
def t06s(h):
    a = h.approvals.select(
        "id", "tenant_id", C("requested_at").alias("ts"), F.unix_micros("requested_at").alias("seq"), "status", "on_timeout", "escalated",
        F.unix_millis("requested_at").alias("requested_ms"), F.unix_millis("expires_at").alias("expires_ms"))
    # two last rows later than every deadline, also the one after an escalation
    end = a.agg(F.max(2 * C("expires_ms") - C("requested_ms")).alias("m"))
    tick = lambda days: end.select(
        F.lit("").alias("id"), F.lit("").alias("tenant_id"), F.timestamp_millis(C("m") + days * 86_400_000).alias("ts"), F.lit(0).cast("bigint").alias("seq"), F.lit("approved").alias("status"),
        F.lit("").alias("on_timeout"), F.lit(False).alias("escalated"), C("m").alias("requested_ms"), C("m").alias("expires_ms"))
    return rt.run_available(sf.approval_timers(rt.replayed(a, "ts", "approval-rows", closing=[tick(1), tick(2)])), "approval-timers")


def operations(e):
    op = "CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'release' WHEN 'view' THEN 'check' ELSE 'failure' END"
    return e.select("seq", F.unix_millis("ts").alias("ms"), F.expr("concat('cap-', user_id % 12)").alias("capability"), F.expr(op).alias("op"))


# the rule one operation after the other, as a recursion over the operations of each capability
CIRCUIT_STEPS = """WITH RECURSIVE op AS (SELECT seq, epoch_us(ts) // 1000 AS ms, 'cap-' || (user_id % 12) AS capability, row_number() OVER (PARTITION BY user_id % 12 ORDER BY seq) AS n,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'release' WHEN 'view' THEN 'check' ELSE 'failure' END AS op FROM hist_events),
walk AS (SELECT DISTINCT capability, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'closed' AS state, CAST(0 AS INT) AS failures, CAST(NULL AS BIGINT) AS opened, false AS probing,
  CAST(NULL AS BOOLEAN) AS allowed, CAST(NULL AS BIGINT) AS retry_after_ms FROM op
UNION ALL SELECT o.capability, o.n, o.seq,
  CASE WHEN o.op = 'success' THEN 'closed' WHEN o.op = 'check' AND w.state = 'open' AND o.ms >= w.opened + 3600000 THEN 'half-open'
   WHEN o.op = 'failure' AND (w.state = 'half-open' OR w.failures + 1 >= 5) THEN 'open' ELSE w.state END,
  CASE WHEN o.op = 'success' THEN 0 WHEN o.op = 'failure' AND w.state <> 'half-open' THEN w.failures + 1 ELSE w.failures END,
  CASE WHEN o.op = 'success' THEN NULL WHEN o.op = 'failure' AND (w.state = 'half-open' OR (w.state = 'closed' AND w.failures + 1 >= 5)) THEN o.ms ELSE w.opened END,
  CASE WHEN o.op <> 'check' THEN false WHEN w.state = 'half-open' OR (w.state = 'open' AND o.ms >= w.opened + 3600000) THEN true ELSE w.probing END,
  CASE WHEN o.op = 'check' THEN w.state = 'closed' OR (w.state = 'open' AND o.ms >= w.opened + 3600000) OR (w.state = 'half-open' AND NOT w.probing) END,
  CASE WHEN o.op = 'check' AND w.state = 'open' AND o.ms < w.opened + 3600000 THEN w.opened + 3600000 - o.ms WHEN o.op = 'check' AND w.state = 'half-open' AND w.probing THEN 1000 END
FROM walk w JOIN op o ON o.capability = w.capability AND o.n = w.n + 1)
"""
CIRCUIT_COUNTS = CIRCUIT_STEPS + "SELECT capability, state, count(*) AS n, count(*) FILTER (NOT allowed) AS refused FROM walk WHERE n > 0 GROUP BY 1, 2"


def replayed_circuits(h):
    return sf.replay_circuits(operations(h.events), cooldown_ms=3_600_000, rows_per_chunk=100_000)


@query("t07_circuits", CIRCUIT_COUNTS)
def t07(h):
    return replayed_circuits(h).groupBy("capability", "state").agg(F.count("*").alias("n"), F.count_if(~C("allowed")).alias("refused"))


@query("t07_circuit_operations", CIRCUIT_STEPS + "SELECT seq, capability, state, failures, allowed, retry_after_ms FROM walk WHERE n > 0")
def t07o(h):
    return replayed_circuits(h).select("seq", "capability", "state", "failures", "allowed", "retry_after_ms")


@query("t07_circuits_stream", CIRCUIT_COUNTS)
def t07s(h):
    out = sf.on_stream(operations(stream(h)), ["capability"], ["seq"], lambda: sf.Circuit(5, 3_600_000), sf.Circuit.fields)
    r = rt.run_available(out, "circuits")
    return r.groupBy("capability", "state").agg(F.count("*").alias("n"), F.count_if(~C("allowed")).alias("refused"))


@query("t08_daily_cost_stream", "SELECT tenant_id, event_type AS workflow_name, strftime(ts, '%Y-%m-%d') AS day, floor(sum(value) * 100.0 + 0.5) / 100.0 AS cost FROM hist_events WHERE value > 0 GROUP BY 1, 2, 3")
def t08(h):
    c = stream(h).select("tenant_id", C("event_type").alias("workflow_name"), "ts", C("value").alias("cost"))
    out = rt.run_available(so.daily_cost(c), "cost", mode="update")
    d = rt.newest_per_key(out, ["tenant_id", "workflow_name", "day"])
    return d.select("tenant_id", "workflow_name", C("day").cast("string").alias("day"), st.half_up(C("cost"), 2).alias("cost"))


def attempts(events):
    op = "CASE event_type WHEN 'error' THEN 'release' WHEN 'purchase' THEN 'complete' ELSE 'claim' END"
    return events.select("seq", "tenant_id", F.lit("http").alias("capability"), F.expr("cast(user_id % 30 as string)").alias("key"), F.unix_millis("ts").alias("ms"),
                           F.expr(op).alias("op"), F.concat(F.lit("run-"), (C("user_id") % 60).cast("string")).alias("owner"), C("props").alias("output"))


LEDGER_STEPS = """WITH RECURSIVE att AS (SELECT seq, tenant_id, user_id % 30 AS key, epoch_us(ts) // 1000 AS ms, 'run-' || (user_id % 60) AS owner, props AS output,
  CASE event_type WHEN 'error' THEN 'release' WHEN 'purchase' THEN 'complete' ELSE 'claim' END AS op, row_number() OVER (PARTITION BY tenant_id, user_id % 30 ORDER BY ts, seq) AS n FROM hist_events),
walk AS (SELECT DISTINCT tenant_id, key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS output,
  CAST(NULL AS BIGINT) AS expires, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS BOOLEAN) AS reclaimed, CAST(NULL AS VARCHAR) AS replayed FROM att
UNION ALL SELECT tenant_id, key, n, seq,
  CASE result WHEN 'claimed' THEN 'in-progress' WHEN 'completed' THEN 'succeeded' WHEN 'released' THEN NULL ELSE state END,
  CASE result WHEN 'claimed' THEN asker WHEN 'released' THEN NULL ELSE owner END,
  CASE result WHEN 'completed' THEN given WHEN 'claimed' THEN NULL WHEN 'released' THEN NULL ELSE output END,
  CASE result WHEN 'claimed' THEN ms + 7200000 WHEN 'completed' THEN ms + 86400000 WHEN 'released' THEN NULL ELSE expires END,
  result, CASE WHEN result = 'claimed' THEN state IS NOT NULL END, CASE WHEN result = 'replay' THEN output END
FROM (SELECT a.tenant_id, a.key, a.n, a.seq, a.ms, a.owner AS asker, a.output AS given, w.state, w.owner, w.output, w.expires,
  CASE a.op WHEN 'claim' THEN CASE WHEN coalesce(w.expires > a.ms, false) AND w.state = 'succeeded' THEN 'replay' WHEN coalesce(w.expires > a.ms, false) AND w.owner <> a.owner THEN 'busy' ELSE 'claimed' END
   WHEN 'complete' THEN CASE WHEN w.state IS NOT NULL AND w.owner = a.owner THEN 'completed' ELSE 'ignored' END
   ELSE CASE WHEN w.state = 'in-progress' AND w.owner = a.owner THEN 'released' ELSE 'ignored' END END AS result
  FROM walk w JOIN att a ON a.tenant_id = w.tenant_id AND a.key = w.key AND a.n = w.n + 1))
"""


def classified(h):
    return sf.classify_attempts(attempts(h.events), lease_ms=7_200_000, ttl_ms=86_400_000)


@query("t09_idempotency_ledger", LEDGER_STEPS + "SELECT tenant_id, result, count(*) AS n, count(*) FILTER (reclaimed) AS reclaimed FROM walk WHERE n > 0 GROUP BY 1, 2")
def t09(h):
    return classified(h).groupBy("tenant_id", "result").agg(F.count("*").alias("n"), F.count_if("reclaimed").alias("reclaimed"))


@query("t09_ledger_attempts", LEDGER_STEPS + "SELECT seq, tenant_id, result, reclaimed, replayed FROM walk WHERE n > 0")
def t09a(h):
    return classified(h).select("seq", "tenant_id", "result", "reclaimed", "replayed")


@query(
    "t10_alert_transitions",
    f"""WITH c AS (SELECT tenant_id, key FROM ({L01}) UNION ALL SELECT tenant_id, key FROM ({L02}) UNION ALL SELECT tenant_id, key FROM ({L03}) UNION ALL SELECT tenant_id, key FROM ({L04})),
o AS (SELECT DISTINCT tenant_id, 'runs-stalled:' || workflow_name AS key FROM runs WHERE status = 'running' UNION ALL SELECT DISTINCT tenant_id, 'old:' || workflow_name FROM runs)
SELECT coalesce(c.tenant_id, o.tenant_id) AS tenant_id, coalesce(c.key, o.key) AS key, CASE WHEN c.key IS NULL THEN 'resolved' WHEN o.key IS NULL THEN 'raised' ELSE 'reminder' END AS event,
  CASE WHEN c.key IS NULL THEN CAST(28800000 AS BIGINT) END AS open_for_ms FROM c FULL OUTER JOIN o ON o.tenant_id = c.tenant_id AND o.key = c.key""",
)
def t10(h):
    at = ts("2001-08-02 00:00:00")
    now = al.evaluate(h.runs, h.live_steps, h.approvals, at, CFG)
    def known(df, prefix):
        return df.select("tenant_id", F.concat(F.lit(prefix), "workflow_name").alias("key")).distinct()

    before = known(h.runs.where("status = 'running'"), "runs-stalled:").unionByName(known(h.runs, "old:"))
    raised = at - F.expr("make_dt_interval(0, 8)")
    open_ = before.select("tenant_id", "key", *[F.lit("x").alias(c) for c in ("severity", "title", "message")], raised.alias("raised_at"), raised.alias("last_notified_at"))
    return al.transitions(now, open_, at).select("tenant_id", "key", "event", "open_for_ms")


LIFE = """WITH e AS (SELECT tenant_id, 'k' || (user_id % 40) AS key, least(floor((epoch_us(ts) - lo) * 4 / (hi - lo + 1)), 3) AS batch
  FROM hist_events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM hist_events) WHERE event_type = 'error' AND user_id % 7 = floor((epoch_us(ts) - lo) * 4 / (hi - lo + 1))),
s AS (SELECT DISTINCT tenant_id, key, CAST(batch AS BIGINT) AS batch, 1 AS seen FROM e), k AS (SELECT DISTINCT tenant_id, key FROM s),
g AS (SELECT k.tenant_id, k.key, b.batch, coalesce(s.seen, 0) AS seen FROM k CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS batch) b LEFT JOIN s ON s.tenant_id = k.tenant_id AND s.key = k.key AND s.batch = b.batch),
w AS (SELECT *, coalesce(lag(seen) OVER (PARTITION BY tenant_id, key ORDER BY batch), 0) AS was FROM g)
SELECT tenant_id, key, CAST(batch AS BIGINT) AS batch, CASE WHEN seen = 0 THEN 'resolved' WHEN was = 0 THEN 'raised' ELSE 'reminder' END AS event,
  CASE WHEN seen = 0 THEN (SELECT count(*) FROM w x WHERE x.tenant_id = w.tenant_id AND x.key = w.key AND x.batch < w.batch
    AND x.batch > coalesce((SELECT max(y.batch) FROM w y WHERE y.tenant_id = w.tenant_id AND y.key = w.key AND y.batch < w.batch AND y.seen = 0), -1)) * 86400000 END AS open_for_ms
FROM w WHERE seen = 1 OR was = 1"""


@query("t10_alert_life", LIFE)
def t10l(h):
    """Errors of four spans of time, one micro-batch a day each: alerts are raised, reminded of, resolved and raised again."""
    lo, hi = h.events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    span = F.least(F.floor((F.unix_micros("ts") - (lo or 0)) * 4 / ((hi or 0) - (lo or 0) + 1)), F.lit(3))
    e = h.events.select("tenant_id", F.expr("concat('k', user_id % 40)").alias("key"), "ts", "event_type", "user_id", span.alias("span"))
    rows = rt.replayed(e, "ts", "alert-batches")

    def step_of(base):
        n = {"day": 0}

        def evaluate(batch):
            at = ts("2024-02-01 00:00:00") + F.expr(f"make_dt_interval({n['day']})")
            found = batch.where((C("event_type") == "error") & (C("user_id") % 7 == C("span"))).select("tenant_id", "key").distinct()
            return found.select("*", *[F.lit(x).alias(x) for x in ("severity", "title", "message")]), at, True

        life = so.alert_lifecycle(evaluate, f"{base}/alerts", al.AlertConfig(renotify_ms=3_600_000))

        def step(batch, number):
            n["day"] = number
            life(batch, number)

        return step

    base = rt.run_each(rows, "alert-life", step_of)
    done = h.spark.read.schema("tenant_id string, key string, event string, open_for_ms bigint, batch bigint").parquet(f"{base}/alerts")
    return done.select("tenant_id", "key", "batch", "event", "open_for_ms")


@query("t10_alert_lifecycle_stream", "SELECT DISTINCT tenant_id, 'k' || (user_id % 40) AS key, 'raised' AS event FROM hist_events WHERE event_type = 'error'")
def t10s(h):
    e = stream(h).where("event_type = 'error'").select("tenant_id", F.expr("concat('k', user_id % 40)").alias("key"))

    def evaluate(batch):
        found = batch.distinct().select("tenant_id", "key", *[F.lit(x).alias(x) for x in ("severity", "title", "message")])
        return found, ts("2024-02-01 00:00:00"), True

    base = rt.run_each(e, "alerts", lambda at: so.alert_lifecycle(evaluate, f"{at}/alerts"))
    done = h.spark.read.schema("tenant_id string, key string, event string, batch bigint").parquet(f"{base}/alerts")
    return rt.newest_per_key(done, ["tenant_id", "key"])


@query("t11_fan_out_stream", "SELECT e.seq, h.hook_id, e.type FROM hist_events e JOIN hooks h ON h.tenant_id = e.tenant_id AND list_contains(h.events, e.type) WHERE e.seq > 500")
def t11(h):
    e = stream(h).select("seq", "tenant_id", "ts", "type")
    return rt.run_available(so.fan_out(e, h.hooks, after_seq=500), "deliveries").select("seq", "hook_id", "type")


@query("t11_outbox_mirror", "SELECT type || ':' || e.id AS id, 'org-' || e.tenant_id AS org_id, seq FROM hist_events e WHERE type = 'run.succeeded' AND tenant_id <> 't3'")
def t11b(h):
    orgs = h.events.select("tenant_id").distinct().where("tenant_id <> 't3'").select("tenant_id", F.concat(F.lit("org-"), "tenant_id").alias("org_id"))
    return so.mirror(h.events, orgs).select("id", "org_id", "seq")


SCHED = "SELECT 'trg-' || s_suppkey AS trigger_id, s_suppkey FROM supplier"


def schedules(h):
    s = h.raw("supplier")
    return s.select(
        F.expr("concat('trg-', s_suppkey)").alias("trigger_id"), "s_suppkey",
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN '0 */6 * * *' ELSE '30 9 * * mon-fri' END").alias("cron"), F.lit("UTC").alias("zone"),
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'one' ELSE 'none' END").alias("catchup"), ts("2024-01-01 00:00:00").alias("from_ts"), ts("2024-01-15 00:00:00").alias("to_ts"))


SLOTS = f"""SELECT trigger_id, s_suppkey, slot FROM ({SCHED}) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 06:00:00', TIMESTAMP '2024-01-15 00:00:00', INTERVAL 6 HOUR)) AS slot) WHERE s_suppkey % 2 = 0
UNION ALL SELECT trigger_id, s_suppkey, slot FROM ({SCHED}) s, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 09:30:00', TIMESTAMP '2024-01-15 00:00:00', INTERVAL 1 DAY)) AS slot) WHERE s_suppkey % 2 = 1 AND isodow(slot) <= 5"""


@query("u02_cron_slots", f"SELECT trigger_id, {iso_sql('slot')} AS slot FROM ({SLOTS})")
def u02(h):
    return cron.expected_slots(schedules(h)).select("trigger_id", st.iso(C("slot")).alias("slot"))


@query(
    "t12_missed_slots",
    f"""SELECT trigger_id, {iso_sql('slot')} AS slot, CASE WHEN (s_suppkey + day(slot)) % 5 = 0 THEN 'missed' WHEN (s_suppkey + day(slot)) % 5 IN (3, 4) AND s_suppkey % 3 <> 0 THEN 'rejected' ELSE 'fired' END AS verdict FROM ({SLOTS})""",
)
def t12(h):
    s = cron.expected_slots(schedules(h))
    n = (C("s_suppkey") + F.day("slot")) % 5
    handled = s.where(n != 0).select("trigger_id", "slot", (C("slot") + F.expr("make_dt_interval(0, 0, 0, CASE WHEN (s_suppkey + day(slot)) % 5 >= 3 THEN 90 ELSE 20 END)")).alias("handled_at"))
    return cron.classify_slots(s, handled).select("trigger_id", st.iso(C("slot")).alias("slot"), "verdict")


@query(
    "t13_event_trigger_requests",
    """SELECT DISTINCT t.id AS trigger_id, e.type || ':' || (e.user_id % 25) AS fire_key FROM hist_events e JOIN triggers t ON t.tenant_id = e.tenant_id AND t.on_event = e.type
WHERE t.enabled AND t.type = 'event' AND (t.min_value IS NULL OR e.value >= t.min_value)""",
)
def t13(h):
    # the state operator carries every column of a pair, so only those that the request needs
    e = stream(h).select("seq", "tenant_id", "ts", "type", "value", (C("user_id") % 25).cast("string").alias("correlation"))
    triggers = h.triggers.select("id", "tenant_id", "on_event", "type", "enabled", "min_value")
    r = so.event_trigger_requests(e, triggers, F.expr("min_value IS NULL OR value >= min_value"))
    return rt.run_available(r, "requests").select("trigger_id", "fire_key")


def run_events(e):
    return e.select("tenant_id", "run_id", "seq", F.unix_millis("ts").alias("ms"), "type", C("value").alias("cost"), F.expr("CASE WHEN event_type = 'error' THEN concat('E', seq % 3) END").alias("code"))


RUNSTATE = """SELECT tenant_id, run_id, arg_max(CASE type WHEN 'run.started' THEN 'running' ELSE 'succeeded' END, seq) FILTER (type IN ('run.started','run.succeeded')) AS status,
 arg_min(epoch_us(ts) // 1000, seq) FILTER (type = 'run.started') AS started_ms, arg_max(epoch_us(ts) // 1000, seq) FILTER (type = 'run.succeeded') AS finished_ms,
 floor(sum(value) * 100.0 + 0.5) / 100.0 AS cost, arg_max('E' || (seq % 3), seq) FILTER (event_type = 'error') AS code FROM hist_events GROUP BY 1, 2"""


@query("t14_run_states", RUNSTATE)
def t14(h):
    return sf.run_states(run_events(h.events)).withColumn("cost", st.half_up(C("cost"), 2))


@query("t14_run_states_stream", RUNSTATE)
def t14s(h):
    out = rt.run_available(sf.on_stream(run_events(rt.replayed(h.events, "ts", "run-events")), ["tenant_id", "run_id"], ["seq"], sf.RunState, "status string, started_ms bigint, finished_ms bigint, total double, last_code string"), "runs")
    last = out.groupBy("tenant_id", "run_id").agg(F.max_by(F.struct("status", "started_ms", "finished_ms", "total", "last_code"), "seq").alias("r"))
    return last.select("tenant_id", "run_id", "r.status", "r.started_ms", "r.finished_ms", st.half_up(C("r.total"), 2).alias("cost"), C("r.last_code").alias("code"))


@query(
    "t15_lockouts",
    """WITH l AS (SELECT seq, tenant_id, user_id, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS ok FROM hist_events), s AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, user_id ORDER BY seq) AS streak FROM l),
n AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, user_id, streak ORDER BY seq) AS n FROM s)
SELECT seq, CAST(CASE WHEN ok THEN 0 ELSE n % 5 END AS INTEGER) AS failures, NOT ok AND n % 5 = 0 AS locked, CASE WHEN NOT ok AND n % 5 = 0 THEN ms + 900000 END AS locked_until_ms FROM n""",
)
def t15(h):
    l = h.events.select("seq", "tenant_id", "user_id", F.unix_millis("ts").alias("ms"), (C("event_type") == "purchase").alias("ok"))
    return sf.lockouts(l, rows_per_chunk=100_000).select("seq", "failures", "locked", "locked_until_ms")


CANARY = """WITH r AS (SELECT tenant_id, 'wf' || (user_id % 4) AS wf, seq, event_type, row_number() OVER (PARTITION BY tenant_id, user_id % 4 ORDER BY ts DESC, seq DESC) AS rn FROM hist_events)
SELECT tenant_id, wf AS workflow_name, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, count(*) >= 5 AND count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.3 AS roll_back
FROM r WHERE rn <= 100 AND event_type IN ('error','purchase') AND seq % 2 = 0 GROUP BY 1, 2"""


def canary_runs(e):
    return e.select(
        "tenant_id", F.expr("concat('wf', user_id % 4)").alias("workflow_name"), F.lpad(C("seq").cast("string"), 12, "0").alias("id"),
        F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END").alias("status"),
        (C("seq") % 2 == 0).alias("canary"), F.lit("2.0.0").alias("workflow_version"), C("ts").alias("created_at"))


@query("t16_canary_stream", CANARY)
def t16(h):
    history = rt.run_available(canary_runs(stream(h)), "canary")
    settings = history.select("tenant_id", C("workflow_name").alias("name")).distinct().withColumn("canary_version", F.lit("2.0.0")).withColumn("canary_percent", F.lit(10))
    return rk.canary_verdicts(history, settings).drop("canary_version")


@query("t16_canary_watch", CANARY)
def t16w(h):
    runs = canary_runs(h.events)
    settings = runs.select("tenant_id", C("workflow_name").alias("name")).distinct().withColumn("canary_version", F.lit("2.0.0")).withColumn("canary_percent", F.lit(10))
    trials = rt.run_available(so.canary_trials(rt.replayed(runs, "created_at", "canary-runs")), "canary-watch", mode="update")
    return so.trial_verdicts(rt.newest_per_key(trials, ["tenant_id", "workflow_name"]), settings).drop("canary_version")


@query("s05_tail_events", "SELECT seq, type FROM hist_events WHERE tenant_id = 't2' AND seq > 300")
def s05(h):
    e = stream(h).select("seq", "tenant_id", "ts", "type", "run_id")
    return rt.run_available(so.tail(e, tenant="t2", after_seq=300), "tail").select("seq", "type")


@query(
    "s05_until_terminal",
    "SELECT e.seq, e.run_id FROM hist_events e LEFT JOIN (SELECT tenant_id, run_id, min(seq) AS last FROM hist_events WHERE type = 'run.succeeded' GROUP BY 1, 2) t ON t.tenant_id = e.tenant_id AND t.run_id = e.run_id WHERE t.last IS NULL OR e.seq <= t.last",
)
def s05b(h):
    return so.until_terminal(h.events).select("seq", "run_id")


@query("u01_canonical_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"x\":[1,\"é\",0.5]}' AS js FROM events")
def u01(h):
    from tidemark.functions.canonical import canonical_json

    text = F.concat(F.lit('{"x": [1.0, "\\u00e9", 5e-1], '), F.substring("props", F.lit(2), F.length("props")))
    return h.raw("events").select("event_id", canonical_json(text).alias("js"))


@query("u05_keyed_state", LEDGER_STEPS + "SELECT tenant_id, result, count(*) AS n, count(*) FILTER (reclaimed) AS reclaimed FROM walk WHERE n > 0 GROUP BY 1, 2")
def u05(h):
    out = sf.on_stream(attempts(rt.replayed(h.events, "ts", "attempts")), ["tenant_id", "capability", "key"], ["ms", "seq"], lambda: sf.Ledger(7_200_000, 86_400_000), sf.Ledger.fields)
    r = rt.run_available(out, "ledger")
    return r.groupBy("tenant_id", "result").agg(F.count("*").alias("n"), F.count_if("reclaimed").alias("reclaimed"))
