"""Queries: event checks, audit chain, payloads, retention, recovery."""

from pyspark.sql import functions as F

from tidemark.functions.canonical import redact_json
from tidemark.operators import quality as ql
from tidemark.operators.skew import chunked_lag
from tidemark.session import cut_lineage
from workload.alerts import VERIFY, content, verified
from workload.joins import EXPIRED, STALE_TENANTS
from workload.registry import query
from workload.views import ts


@query(
    "q01_validate_events",
    """SELECT seq, CASE type WHEN 'run.started' THEN NULL WHEN 'run.succeeded' THEN NULL ELSE 'MISSING_EVENT_FIELD' END AS code,
  CASE WHEN type LIKE 'step.%' THEN 'data.attempt' END AS field FROM hist_events""",
)
def q01(h):
    return ql.validate_events(h.events).select("seq", "code", "field")



@query(
    "q02_truncate_payloads",
    """WITH d AS (SELECT doc_id, octet_length(encode(CAST(to_json({'attempt': 1, 'durationMs': doc_id, 'text': text}) AS VARCHAR))) > 4096 AS truncated FROM documents)
SELECT doc_id, truncated, CASE WHEN truncated THEN 'attempt,durationMs,_truncated,_droppedKeys,_note' ELSE 'attempt,durationMs,text' END AS keys,
  CASE WHEN truncated THEN 'text' END AS dropped FROM d""",
)
def q02(h):
    d = h.raw("documents")
    data = F.to_json(F.struct(F.lit(1).alias("attempt"), F.col("doc_id").alias("durationMs"), F.col("text")))
    e = d.select("doc_id", F.lit("step.succeeded").alias("type"), data.alias("data"))
    t = ql.truncate_payloads(e, 4096)
    return t.select("doc_id", "truncated", F.array_join(F.json_object_keys("data"), ",").alias("keys"), F.get_json_object("data", "$._droppedKeys[0]").alias("dropped"))


@query("q03_verify_chain", VERIFY)
def q03(h):
    return verified(h)


# rows 211, 422, … were changed after their hash was taken; one of 4999 has a link that does not fit
CHANGED = """WITH c AS (SELECT *, CASE WHEN seq % 4999 = 4998 THEN 'cut' ELSE coalesce(lag(hash) OVER (PARTITION BY tenant_id ORDER BY seq), 'genesis') END AS link,
  coalesce(lag(hash) OVER (PARTITION BY tenant_id ORDER BY seq), 'genesis') AS want, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS rn FROM hist_events WHERE tenant_id <> 't1' OR seq % 211 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS first FROM c WHERE link <> want OR sha256((seq - 1) || '|' || user_id || '|' || event_type || '|' || props || CASE WHEN seq % 211 = 0 THEN ' ' ELSE '' END) <> hash)
SELECT t.tenant_id, b.seq IS NULL AS ok, coalesce(b.rn - 1, t.n) AS checked, b.seq AS broken_at_seq,
  CASE WHEN b.link <> b.want THEN 'chain link does not match the previous event' WHEN b.seq IS NOT NULL THEN 'event content does not match its hash' END AS reason
FROM (SELECT tenant_id, count(*) AS n FROM c GROUP BY 1) t LEFT JOIN b ON b.tenant_id = t.tenant_id AND b.first = 1"""


def changed_log(h):
    e = h.events.where("tenant_id <> 't1' OR seq % 211 <> 0")
    e = chunked_lag(e, ["tenant_id"], "seq", {"hash": "before"}, rows_per_chunk=100_000)
    return e.withColumn("prev_hash", F.expr("CASE WHEN seq % 4999 = 4998 THEN 'cut' ELSE coalesce(before, 'genesis') END")).withColumn(
        "props", F.expr("CASE WHEN seq % 211 = 0 THEN concat(props, ' ') ELSE props END"))


@query("q03_verify_content", CHANGED)
def q03c(h):
    return ql.verify_chain(changed_log(h), content_hash=content(), genesis="genesis", rows_per_chunk=1_000)


@query("q03_verify_resumed", CHANGED)
def q03r(h):
    """First the older third, then the rest from the verified heads: the same as in one go."""
    log = cut_lineage(changed_log(h), "changed-log")
    early = ql.verify_further(log.where(F.col("ts") < ts("2024-01-10 00:00:00")), None, content(), "genesis", 1_000)
    heads = cut_lineage(ql.verified_heads(early), "verified-heads")
    return ql.verify_further(log, heads, content(), "genesis", 1_000).drop("head_seq", "head_hash")


STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'waiting-event' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"
LEGAL = "(('queued','running'),('running','waiting-event'),('running','succeeded'),('running','failed'),('waiting-event','running'),('waiting-event','failed'))"


@query(
    "q04_illegal_transitions",
    f"""WITH s AS (SELECT seq, run_id, {STATUS} AS status FROM hist_events), l AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS from_status FROM s)
SELECT seq, run_id, from_status, status FROM l WHERE from_status IS NOT NULL AND from_status <> status AND (from_status, status) NOT IN {LEGAL}""",
)
def q04(h):
    s = h.events.select("seq", "run_id", F.expr(STATUS).alias("status"))
    return ql.illegal_transitions(s, rows_per_chunk=100_000).select("seq", "run_id", "from_status", "status")


@query(
    "q05_validate_json",
    """SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 90 THEN 'k:maximum;' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'mode:enum;' WHEN event_id % 3 = 1 THEN 'mode:required;' ELSE '' END
  || CASE WHEN event_id % 4 = 0 THEN '$:additionalProperties;' ELSE '' END AS issues, '7' AS retries FROM events""",
)
def q05(h):
    mode = "CASE event_id % 3 WHEN 0 THEN ', \"mode\": \"odd\"' WHEN 1 THEN '' ELSE ', \"mode\": \"fast\"' END"
    extra = "CASE WHEN event_id % 4 = 0 THEN ', \"x\": 1' ELSE '' END"
    e = h.raw("events").select("event_id", F.expr(f"concat(substr(props, 1, length(props) - 1), {mode}, {extra}, '}}')").alias("inputs"))
    spec = {
        "k": ql.Field("integer", required=True, minimum=0, maximum=90),
        "mode": ql.Field("string", required=True, enum=("fast", "slow")),
        "retries": ql.Field("integer", default="7"),
    }
    v = ql.validate_json(e, "inputs", spec)
    shown = F.concat_ws("", F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"], F.lit(";"))))
    return v.select("event_id", shown.alias("issues"), F.get_json_object("filled", "$.retries").alias("retries"))


@query(
    "q06_redact_json",
    """SELECT c_custkey, c_name AS name, '[REDACTED]' AS token, 'call [REDACTED] now' AS note, CAST(c_nationkey AS VARCHAR) AS password FROM customer""",
)
def q06(h):
    c = h.raw("customer").select(
        "c_custkey",
        F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("abc").alias("api_token"), F.concat(F.lit("call Bearer abcdef"), F.lpad("c_custkey", 9, "0"), F.lit(" now")).alias("note"),
                           F.col("c_nationkey").alias("password"))).alias("doc"))
    r = c.withColumn("doc", redact_json(F.col("doc")))
    g = lambda p: F.get_json_object("doc", p)
    return r.select("c_custkey", g("$.name").alias("name"), g("$.api_token").alias("token"), g("$.note").alias("note"), g("$.password").alias("password"))


CUT = "2024-01-15 00:00:00"
RETENTION = f"""WITH art AS ({EXPIRED.replace('1999-01-01', '2024-01-15')}), acc AS ({STALE_TENANTS.replace('2001-09-01', '2024-01-15')})
SELECT 'artifact' AS kind, tenant_id, hash AS id FROM art UNION ALL SELECT 'account', id, id FROM acc
UNION ALL SELECT 'outbox', tenant_id, id FROM outbox WHERE sent_at < TIMESTAMP '{CUT}'
UNION ALL SELECT 'delivery', tenant_id, id FROM deliveries WHERE status <> 'pending' AND created_at < TIMESTAMP '{CUT}'"""


@query("q10_retention", RETENTION)
def q10(h):
    versions = h.account_runs.where("workflow_name = '1-URGENT'")
    return ql.retention_candidates(h.artifacts, h.tenants, h.users, h.runs, h.account_runs.where("status = 'failed'"), versions, h.outbox, h.deliveries, ts(CUT))


GONE = "SELECT id AS tenant_id FROM tenants WHERE disabled"


@query(
    "q11_purge_tenants",
    f"""WITH g AS ({GONE}) SELECT 'tenants' AS tbl, count(*) AS n FROM tenants WHERE id NOT IN (SELECT tenant_id FROM g)
UNION ALL SELECT 'users', count(*) FROM users WHERE tenant_id NOT IN (SELECT tenant_id FROM g)
UNION ALL SELECT 'runs', count(*) FROM account_runs WHERE tenant_id NOT IN (SELECT tenant_id FROM g)
UNION ALL SELECT 'step_states', count(*) FROM steps WHERE run_id NOT IN (SELECT id FROM account_runs WHERE tenant_id IN (SELECT tenant_id FROM g))
UNION ALL SELECT 'events', count(*) FROM hist_events""",
)
def q11(h):
    gone = h.tenants.where("disabled").select(F.col("id").alias("tenant_id"))
    left = ql.purge_tenants({"tenants": h.tenants, "users": h.users, "runs": h.account_runs, "step_states": h.steps, "events": h.events}, gone)
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "q12_orphaned_steps",
    """SELECT r.tenant_id, s.run_id, s.step_id, 'retry-wait' AS new_status, greatest(0, s.attempt - 1) AS new_attempt, s.compensation_status AS new_compensation
FROM live_steps s JOIN runs r ON r.id = s.run_id WHERE s.status = 'running' AND r.status IN ('running','waiting-approval','waiting-event','compensating')""",
)
def q12(h):
    return ql.orphaned_steps(h.live_steps, h.runs)


READY = """WITH e AS (SELECT DISTINCT plan_hash, step_id, depends_on FROM order_edges),
d AS (SELECT p.run_id, p.step_id, s.status, s.handled FROM live_steps p JOIN e ON e.plan_hash = p.run_id AND e.step_id = p.step_id JOIN live_steps s ON s.run_id = p.run_id AND s.step_id = e.depends_on WHERE p.status = 'pending'),
g AS (SELECT run_id, step_id, bool_and(status IN ('succeeded','failed','skipped','cancelled')) AS done,
  bool_or(NOT (status IN ('succeeded','skipped') OR (status = 'failed' AND coalesce(handled = 'continue', false)))) AS blocked, bool_and(status = 'skipped') AS all_skipped FROM d GROUP BY 1, 2)
SELECT p.run_id, p.step_id, CASE WHEN g.done IS NULL THEN 'run' WHEN NOT g.done THEN 'wait' WHEN g.blocked THEN 'upstream-failed' WHEN g.all_skipped THEN 'upstream-skipped' ELSE 'run' END AS verdict
FROM live_steps p LEFT JOIN g ON g.run_id = p.run_id AND g.step_id = p.step_id WHERE p.status = 'pending'"""


@query("q13_step_readiness", READY)
def q13(h):
    return ql.step_readiness(h.live_steps.withColumn("plan_hash", F.col("run_id")), h.order_edges)


@query(
    "q14_run_step_summary",
    "SELECT run_id, count(*) FILTER (status = 'failed' AND handled IS NULL) AS unhandled_failures, bool_and(status IN ('succeeded','failed','skipped','cancelled')) AS all_terminal FROM live_steps GROUP BY 1",
)
def q14(h):
    return ql.run_step_summary(h.live_steps)
