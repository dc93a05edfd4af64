"""Queries: joins between history tables."""

from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.operators import aggregates as ag
from tidemark.operators import joins as jn
from workload.aggregates import RUN_STATS, money, since
from workload.registry import query
from workload.views import iso_sql, ts


@query(
    "j01_steps_of_runs",
    "SELECT s.run_id, s.step_id, s.status, r.tenant_id, r.workflow_name FROM steps s JOIN runs r ON r.id = s.run_id",
)
def j01(h):
    return jn.steps_of_runs(h.steps, h.runs).select("run_id", "step_id", "status", "tenant_id", "workflow_name")


@query(
    "j02_last_activity",
    f"SELECT r.tenant_id, r.id, r.workflow_name, {iso_sql('max(coalesce(s.updated_at, r.started_at, r.created_at))')} AS last_activity FROM runs r LEFT JOIN steps s ON s.run_id = r.id GROUP BY 1, 2, 3",
)
def j02(h):
    return jn.last_activity(h.runs, h.steps).withColumn("last_activity", st.iso(F.col("last_activity")))


@query(
    "j03_without_live_step",
    """WITH moving AS (SELECT run_id, bool_or(status = 'running' OR status = 'retry-wait' OR starts_with(status, 'waiting-')) AS any_live FROM live_steps GROUP BY run_id)
SELECT id FROM runs LEFT JOIN moving ON run_id = id WHERE any_live IS NOT TRUE""",
)
def j03(h):
    return jn.without_live_step(h.runs, h.live_steps).select("id")


STALE_TENANTS = """(SELECT tenant_id AS id FROM users GROUP BY tenant_id HAVING bool_and(email_unverified)
INTERSECT SELECT id FROM tenants WHERE created_at < TIMESTAMP '2001-09-01 00:00:00' AND starts_with(id, 'acct-'))
EXCEPT SELECT tenant_id FROM account_runs WHERE status = 'failed' OR workflow_name = '1-URGENT'"""


def stale_tenants(h):
    # an account's published workflows: one version per urgent run of its owner
    versions = h.account_runs.where("workflow_name = '1-URGENT'")
    return jn.stale_unconfirmed_tenants(h.tenants, h.users, h.account_runs.where("status = 'failed'"), versions, ts("2001-09-01 00:00:00"))


@query("j04_stale_unconfirmed_tenants", STALE_TENANTS)
def j04(h):
    return stale_tenants(h).select("id")


EXPIRED = f"""SELECT a.tenant_id, a.hash, a.run_id, {iso_sql('r.finished_at')} AS finished_at FROM artifacts a JOIN runs r ON r.id = a.run_id
WHERE a.tombstoned_at IS NULL AND r.finished_at < TIMESTAMP '1999-01-01 00:00:00' AND r.status IN ('succeeded','failed','rolled-back','compensation-failed','cancelled')"""


@query("j05_expired_artifacts", EXPIRED)
def j05(h):
    e = jn.expired_artifacts(h.artifacts, h.runs, ts("1999-01-01 00:00:00"))
    return e.select("tenant_id", "hash", "run_id", st.iso(F.col("finished_at")).alias("finished_at"))


@query("j06_intervened_runs", "SELECT tenant_id, count(DISTINCT a.run_id) AS n FROM (SELECT run_id FROM approvals) a JOIN runs r ON r.id = a.run_id WHERE NOT r.dry_run GROUP BY 1")
def j06(h):
    return ag.count_by(jn.intervened_runs(h.approvals, h.runs), "tenant_id")


FACTS = f"""SELECT s.tenant_id, s.name AS workflow_name, s.enabled, s.killed, s.stable_version AS version, {iso_sql('s.active_since')} AS active_since,
  coalesce(total, 0) AS total, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, coalesce(cost, 0) AS cost
FROM settings s JOIN (SELECT DISTINCT tenant_id, workflow FROM plan_steps) p ON p.tenant_id = s.tenant_id AND p.workflow = s.name
LEFT JOIN ({RUN_STATS}) g ON g.tenant_id = s.tenant_id AND g.workflow_name = s.name"""


def stable_versions(h):
    return h.settings.select(
        "tenant_id", "name", F.col("stable_version").alias("version"), F.concat_ws("/", "tenant_id", "name").alias("plan_hash"), F.col("active_since").alias("published_at")
    )


def facts(h):
    return jn.workflow_facts(h.settings, stable_versions(h), h.plan_steps, ag.workflow_run_stats(h.runs, since()))


@query("j07_workflow_facts", FACTS)
def j07(h):
    return money(facts(h), "cost").drop("plan_hash").withColumn("active_since", st.iso(F.col("active_since")))


MATCHED = """SELECT e.seq, t.id AS trigger_id, t.workflow_name FROM hist_events e JOIN triggers t ON t.tenant_id = e.tenant_id AND t.on_event = e.type
WHERE t.enabled AND t.type = 'event' AND (t.min_value IS NULL OR e.value >= t.min_value)"""


def matched_triggers(h):
    return jn.events_to_triggers(h.events, h.triggers, F.expr("min_value IS NULL OR value >= min_value"))


@query("j08_events_to_triggers", MATCHED)
def j08(h):
    return matched_triggers(h).select("seq", "trigger_id", "workflow_name")


# conditions as the configuration holds them: two sound ones, one that fails on some values, one that names no column, one that does not parse
CONDITIONS = ["value >= 50", "cast(get_json_object(data, '$.k') AS int) % 2 = 0", "seq % 5 > 0 AND 10 / (seq % 3) > 5", "no_such_column > 1", "value >"]


@query(
    "j08_triggers_with_conditions",
    """SELECT e.seq, t.id AS trigger_id FROM hist_events e JOIN (SELECT *, CAST(split_part(id, '-', 2) AS INT) % 7 AS c FROM triggers) t ON t.tenant_id = e.tenant_id AND t.on_event = e.type
WHERE t.enabled AND t.type = 'event' AND CASE t.c WHEN 0 THEN e.value >= 50 WHEN 1 THEN TRY_CAST(json_extract_string(e.props, '$.k') AS INT) % 2 = 0
 WHEN 2 THEN e.seq % 5 > 0 AND e.seq % 3 > 0 AND 10 / (e.seq % 3) > 5 WHEN 3 THEN false WHEN 4 THEN false ELSE true END""",
)
def j08c(h):
    number = F.split_part("id", F.lit("-"), F.lit(2)).cast("int") % 7
    t = h.triggers.withColumn("condition", F.get(F.array(*map(F.lit, CONDITIONS)), number))
    return jn.where_text_passes(jn.events_to_triggers(h.events, t), "condition", CONDITIONS).select("seq", "trigger_id")


@query(
    "j09_completions_to_triggers",
    """SELECT r.id AS run_id, t.id AS trigger_id FROM runs r JOIN completion_triggers t ON t.tenant_id = r.tenant_id AND t.on_workflow = r.workflow_name
WHERE t.enabled AND t.type = 'completion' AND ((t.want = 'any' AND r.status IN ('succeeded','failed','rolled-back','compensation-failed')) OR (t.want = 'succeeded' AND r.status = 'succeeded')
  OR (t.want = 'failed' AND r.status IN ('failed','rolled-back','compensation-failed')))""",
)
def j09(h):
    return jn.completions_to_triggers(h.runs, h.completion_triggers).select("run_id", "trigger_id")


@query(
    "j10_resume_waits",
    """WITH w AS (SELECT r.tenant_id, s.run_id, s.step_id, s.wait_event, s.wait_correlation FROM live_steps s JOIN runs r ON r.id = s.run_id WHERE s.status = 'waiting-event'),
e AS (SELECT c_mktsegment AS tenant_id, 'e' || (event_id % 5) AS type, CAST(user_id % 50 AS VARCHAR) AS correlation, event_id AS seq FROM events JOIN customer ON c_custkey = user_id)
SELECT w.run_id, w.step_id, min(e.seq) AS seq FROM w JOIN e ON e.tenant_id = w.tenant_id AND e.type = w.wait_event AND (w.wait_correlation IS NULL OR w.wait_correlation = e.correlation) GROUP BY 1, 2""",
)
def j10(h):
    waits = h.live_steps.where("status = 'waiting-event'").join(h.runs.select(F.col("id").alias("run_id"), "tenant_id"), "run_id")
    waits = waits.select("tenant_id", "run_id", "step_id", "wait_event", "wait_correlation")
    ev = h.raw("events").join(h.raw("customer"), F.col("user_id") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("tenant_id"), F.expr("concat('e', event_id % 5)").alias("type"), F.expr("cast(user_id % 50 as string)").alias("correlation"), F.col("event_id").alias("seq"))
    return jn.resume_waits(waits, ev).select("run_id", "step_id", "seq")


FANOUT = "SELECT e.seq, h.hook_id, e.type FROM hist_events e JOIN hooks h ON h.tenant_id = e.tenant_id AND list_contains(h.events, e.type)"


@query("j11_events_to_hooks", FANOUT)
def j11(h):
    return jn.events_to_hooks(h.events.select("seq", "tenant_id", "type"), h.hooks).select("seq", "hook_id", "type")


@query(
    "j12_nearest_names",
    """WITH k AS (SELECT p_name AS name, min(p_partkey) AS position FROM part GROUP BY 1),
u AS (SELECT DISTINCT translate(upper(substr(p_name, 1, 4)) || substr(p_name, 5), 'aeio', 'eaoi') || (p_partkey % 25) AS name FROM part),
d AS (SELECT u.name AS unknown, k.name AS suggestion, levenshtein(lower(u.name), lower(k.name)) AS distance, k.position FROM u, k)
SELECT unknown, suggestion, distance FROM (SELECT *, row_number() OVER (PARTITION BY unknown ORDER BY distance, position) AS rn FROM d)
WHERE rn = 1 AND distance <= greatest(2, length(unknown) // 3)""",
)
def j12(h):
    known = h.raw("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    mangled = "concat(translate(concat(upper(substr(p_name, 1, 4)), substr(p_name, 5)), 'aeio', 'eaoi'), p_partkey % 25)"
    unknown = h.raw("part").select(F.expr(mangled).alias("name"))
    return jn.nearest_names(unknown, known)


@query(
    "j13_dependency_states",
    """SELECT e.plan_hash AS run_id, e.step_id, s.status, e.depends_on, d.status AS dep_status FROM (SELECT DISTINCT plan_hash, step_id, depends_on FROM order_edges) e
JOIN live_steps s ON s.run_id = e.plan_hash AND s.step_id = e.step_id JOIN live_steps d ON d.run_id = e.plan_hash AND d.step_id = e.depends_on""",
)
def j13(h):
    d = jn.dependency_states(h.live_steps.withColumn("plan_hash", F.col("run_id")), h.order_edges)
    return d.select("run_id", "step_id", "status", "depends_on", "dep_status")


@query(
    "j14_usage_against_limits",
    """WITH u AS (SELECT tenant_id, count(*) AS used FROM account_runs WHERE NOT dry_run AND created_at >= TIMESTAMP '2001-07-01 00:00:00' AND created_at < TIMESTAMP '2001-08-01 00:00:00' GROUP BY 1),
j AS (SELECT t.id AS tenant_id, CASE WHEN b.status IN ('active','trialing') AND b.plan IN ('pro','team') THEN b.plan ELSE 'free' END AS plan, coalesce(b.status, 'free') AS status, coalesce(u.used, 0) AS used
FROM tenants t LEFT JOIN billing_accounts b ON b.tenant_id = t.id LEFT JOIN u ON u.tenant_id = t.id),
l AS (SELECT *, CASE plan WHEN 'pro' THEN 500 WHEN 'team' THEN 2500 ELSE 25 END AS run_limit FROM j)
SELECT *, greatest(0, run_limit - used) AS remaining FROM l""",
)
def j14(h):
    used = ag.monthly_runs(h.account_runs, ts("2001-07-15 00:00:00"))
    return jn.usage_against_limits(used, h.billing_accounts, h.tenants)


@query("j16_child_runs", "SELECT r.tenant_id, r.id, r.status, c.id AS child_id, c.status AS child_status FROM runs r JOIN runs c ON c.parent_run_id = r.id")
def j16(h):
    return jn.child_runs(h.runs)
