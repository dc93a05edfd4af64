"""Queries: findings rules, the combined analysis, the proposal queue."""

from pyspark.sql import functions as F

from tidemark.plans import findings as fd
from tidemark.operators import ranking as rk
from tidemark.plans import similarity as sim
from workload.aggregates import APPROVAL_STATS as APPROVALS0
from workload.aggregates import human_sql, pct_sql, rank_sql
from workload.aggregates import RUN_STATS as RUNS0
from workload.aggregates import STEP_ERRORS as ERRORS0
from workload.aggregates import STEP_STATS as STATS0
from workload.joins import stable_versions
from workload.registry import query
from workload.views import BY_TRIGGER_SQL, RUNS_AS_OF, WINDOW_DAYS, ByTrigger, ts

T = fd.Thresholds()
# limits fitted to the bench history, whose failure and cost shares are even
LOOSE = fd.Thresholds(ignored_failure_rate=0.1, cost_workflow_share=0.335, cost_step_share=0.0875, schedule_drift_p95_ms=60_000, queue_wait_p95_ms=120_000, denied_rate=0.24, timeout_rate=0.2, compensation_min_runs=20)


def facts(h, days=WINDOW_DAYS):
    schedules = h.plan_steps.where("scheduled").select("tenant_id", F.col("workflow").alias("workflow_name"))
    return fd.Facts(h.runs, h.steps, h.approvals, h.settings, stable_versions(h), h.plan_steps, schedules, ts(RUNS_AS_OF), days)


def show(df):
    return df.select("rule", "severity", "tenant_id", "workflow", "step_id", "key", "title")


def finding_sql(rule, severity, key, title, body, workflow="workflow_name", step="step_id"):
    wf = workflow or "CAST(NULL AS VARCHAR)"
    st = step or "CAST(NULL AS VARCHAR)"
    return f"SELECT '{rule}' AS rule, {severity} AS severity, tenant_id, {wf} AS workflow, {st} AS step_id, {key} AS key, {title} AS title FROM ({body})"


# these start 1500 days before the reference time, as the facts above do
STATS, ERRORS, APPROVALS, RUNS = STATS0, ERRORS0, APPROVALS0, RUNS0

R01 = finding_sql(
    "ignored-failure", "CASE WHEN rate >= 0.9 THEN 'high' ELSE 'medium' END", "'ignored-failure:' || workflow_name || ':' || step_id",
    f"'Step ''' || step_id || ''' fails ' || {pct_sql('rate')} || ' of the time and the failure is ignored'",
    f"SELECT *, ignored / (succeeded + failed)::DOUBLE AS rate FROM ({STATS}) WHERE ignored >= 5 AND succeeded + failed >= 10 AND ignored / (succeeded + failed)::DOUBLE >= 0.1")


@query("r01_ignored_failure", R01)
def r01(h):
    return show(fd.ignored_failures(facts(h), LOOSE))


R02 = finding_sql(
    "failing-step", "CASE WHEN rate >= 0.7 THEN 'high' ELSE 'medium' END", "'failing-step:' || workflow_name || ':' || step_id",
    f"'Step ''' || step_id || ''' fails ' || {pct_sql('rate')} || ' of the time'",
    f"SELECT *, failed / (succeeded + failed)::DOUBLE AS rate FROM ({STATS}) WHERE failed > ignored AND succeeded + failed >= 10 AND failed / (succeeded + failed)::DOUBLE >= 0.3")


@query("r02_failing_step", R02)
def r02(h):
    return show(fd.failing_steps(facts(h), T))


DEAD = fd.Thresholds(min_samples=1)
R03 = "SELECT 'dead-step' AS rule, 'low' AS severity, tenant_id, workflow_name AS workflow, step_id, 'dead-step:' || workflow_name || ':' || step_id AS key, 'Step ''' || step_id || ''' has never run' AS title FROM ({}) WHERE seen >= {} AND skipped = seen"


@query("r03_dead_step", R03.format(STATS.replace("1997-06-24", "2001-07-23"), 2))
def r03(h):
    # a ten-day window: over years every step of the bench history has run
    return show(fd.dead_steps(facts(h, 10), DEAD))


R04 = finding_sql(
    "retry-storm", "CASE WHEN wrong OR rate >= 0.6 THEN 'high' ELSE 'medium' END", "'retry-storm:' || workflow_name || ':' || step_id",
    f"'Step ''' || step_id || ''' needs retries in ' || {pct_sql('rate')} || ' of runs'",
    f"""SELECT s.*, retried / (succeeded + failed)::DOUBLE AS rate, p.retries_business AND coalesce(b.n, 0) > 0 AS wrong FROM ({STATS}) s
JOIN plan_steps p ON p.tenant_id = s.tenant_id AND p.workflow = s.workflow_name AND p.step_id = s.step_id
LEFT JOIN (SELECT tenant_id, workflow_name, step_id, count(*) AS n FROM ({ERRORS}) WHERE error_class = 'business' GROUP BY 1, 2, 3) b
  ON b.tenant_id = s.tenant_id AND b.workflow_name = s.workflow_name AND b.step_id = s.step_id
WHERE succeeded + failed >= 10 AND retried >= 5 AND retried / (succeeded + failed)::DOUBLE >= 0.3""")


@query("r04_retry_storm", R04)
def r04(h):
    return show(fd.retry_storms(facts(h), T))


def order_workflows(h):
    """Every order's plan as a workflow of its own."""
    p = h.order_plans.withColumn("type", F.lit("capability")).withColumn("with", F.expr("map_filter(`with`, (k, v) -> k <> 'url')"))
    return p.select("tenant_id", F.col("workflow").alias("workflow_name"), "step_id", "order", "type", "capability", "with")


DUP_VIEWS = {
    "dtok": """SELECT tenant_id, workflow, capability || '|brand,note#' || (row_number() OVER (PARTITION BY workflow, capability ORDER BY n) - 1) AS token, n, p_brand AS brand, note FROM order_plans""",
    "dbag": "SELECT tenant_id, workflow, list_sort(list(token)) AS tokens, count(*) AS n FROM dtok GROUP BY 1, 2 HAVING count(*) >= 3",
    "dshape": "SELECT tenant_id, tokens, min(workflow) AS anchor, count(*) AS members, any_value(n) AS n FROM dbag GROUP BY 1, 2",
    "dst": "SELECT tenant_id, anchor, members, n, unnest(tokens) AS token FROM dshape",
    "dcross": """SELECT a.tenant_id, a.anchor AS x, b.anchor AS y, a.members + b.members AS copies, count(*) AS shared, any_value(a.n + b.n) - count(*) AS un
FROM dst a JOIN dst b ON a.tenant_id = b.tenant_id AND a.token = b.token AND a.anchor < b.anchor AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
GROUP BY 1, 2, 3, 4 HAVING count(*) / (any_value(a.n + b.n) - count(*))::DOUBLE >= 0.8""",
    "dsame": """SELECT s.tenant_id, s.anchor AS x, b.workflow AS y, s.members AS copies, b.n AS shared, b.n AS un FROM dbag b JOIN dshape s ON s.tenant_id = b.tenant_id AND s.tokens = b.tokens WHERE b.workflow <> s.anchor""",
    "dpair": "SELECT * FROM dcross UNION ALL SELECT * FROM dsame",
}


@query(
    "r05_duplicate_workflows",
    """WITH d AS (SELECT p.tenant_id, p.x, p.y, p.copies, p.shared, p.un, list_sort(list(DISTINCT split_part(a.token, '|', 1) || '.' || k) FILTER (k IS NOT NULL)) AS params
FROM dpair p LEFT JOIN (SELECT a.workflow AS wa, b.workflow AS wb, a.token, unnest(CASE WHEN a.brand <> b.brand AND a.note <> b.note THEN ['brand','note'] WHEN a.brand <> b.brand THEN ['brand'] WHEN a.note <> b.note THEN ['note'] ELSE [] END) AS k
  FROM dpair q JOIN dtok a ON a.workflow = q.x JOIN dtok b ON b.workflow = q.y AND b.token = a.token) a ON a.wa = p.x AND a.wb = p.y GROUP BY ALL)
SELECT tenant_id, x AS a, y AS b, floor(shared / un::DOUBLE * 100.0 + 0.5) / 100.0 AS similarity, shared, un AS "union", copies, coalesce(array_to_string(params, ','), '') AS parameters FROM d""",
    extra=DUP_VIEWS,
)
def r05(h):
    d = sim.near_duplicates(order_workflows(h), 0.8)
    return d.select("tenant_id", "a", "b", fd.half_up(F.col("similarity"), 2).alias("similarity"), "shared", "union", "copies", F.array_join("parameters", ",").alias("parameters"))


R06 = finding_sql(
    "cost-hotspot", "'medium'", "'cost-hotspot:' || workflow_name", f"'''' || workflow_name || ''' accounts for ' || {pct_sql('share')} || ' of all cost'",
    f"SELECT * FROM (SELECT *, cost / sum(cost) OVER (PARTITION BY tenant_id) AS share, count(*) OVER (PARTITION BY tenant_id) AS costed FROM ({RUNS})) WHERE costed >= 2 AND cost >= 1 AND share >= 0.335", step=None)


@query("r06_cost_hotspot_workflow", R06, extra=BY_TRIGGER_SQL)
def r06(h):
    return show(fd.cost_hotspot_workflows(facts(ByTrigger(h.spark, h.dir)), LOOSE))


# step costs are list prices of lines, run costs are order totals, so the shares are of a different base
R07 = finding_sql(
    "cost-hotspot", "'low'", "'cost-hotspot:' || workflow_name || ':' || step_id", f"'Step ''' || step_id || ''' is ' || {pct_sql('share')} || ' of ' || workflow_name || '''s cost'",
    f"""SELECT * FROM (SELECT s.tenant_id, s.workflow_name, s.step_id, s.cost / r.cost AS share, r.cost / r.total_cost AS wf_share,
 count(*) FILTER (s.cost > 0) OVER (PARTITION BY s.tenant_id, s.workflow_name) AS costed FROM ({STATS}) s
 JOIN (SELECT *, sum(cost) OVER (PARTITION BY tenant_id) AS total_cost FROM ({RUNS})) r ON r.tenant_id = s.tenant_id AND r.workflow_name = s.workflow_name)
WHERE costed >= 2 AND wf_share >= 0.25 AND share >= 0.0875""")


@query("r07_cost_hotspot_step", R07, extra=BY_TRIGGER_SQL)
def r07(h):
    return show(fd.cost_hotspot_steps(facts(ByTrigger(h.spark, h.dir)), LOOSE))


GATES = f"(SELECT *, approved + denied + timed_out AS fin FROM ({APPROVALS}))"


@query(
    "r08_approval_rubber_stamp",
    finding_sql("approval-rubber-stamp", "'low'", "'approval-rubber-stamp:' || workflow_name || ':' || step_id",
                "'Approval ''' || step_id || ''' was approved ' || approved || ' times out of ' || approved",
                """SELECT c_mktsegment AS tenant_id, o_orderpriority AS workflow_name, 'g' || (o_custkey % 400) AS step_id, count(*) FILTER (o_orderstatus <> 'P') AS approved
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3 HAVING count(*) FILTER (o_orderstatus = 'P') = 0 AND count(*) FILTER (o_orderstatus <> 'P') >= 3"""),
)
def r08(h):
    # every order as a decision at a gate of its own customer group: open orders are denials
    o = h.runs.select("tenant_id", "id", "workflow_name", F.expr("concat('g', cast(dedup_key as bigint) % 400)").alias("step_id"), "created_at",
                      F.expr("CASE WHEN status IN ('running','waiting-approval','waiting-event','queued') THEN 'denied' ELSE 'approved' END").alias("status"))
    a = o.select("tenant_id", "id", F.col("id").alias("run_id"), "workflow_name", "step_id", "status", F.col("created_at").alias("requested_at"), F.col("created_at").alias("decided_at"))
    f = fd.Facts(h.runs, h.steps, a, h.settings, stable_versions(h), h.plan_steps, h.plan_steps, ts(RUNS_AS_OF), 100 * 365)
    return show(fd.approval_rubber_stamp(f, fd.Thresholds(rubber_stamp_min_approvals=3)))


@query(
    "r09_approval_often_denied",
    finding_sql("approval-often-denied", "'medium'", "'approval-often-denied:' || workflow_name || ':' || step_id",
                f"'Approval ''' || step_id || ''' is denied ' || {pct_sql('denied / fin::DOUBLE')} || ' of the time'",
                f"SELECT * FROM {GATES} WHERE fin >= 10 AND denied / fin::DOUBLE >= 0.24"),
)
def r09(h):
    return show(fd.approval_often_denied(facts(h), LOOSE))


@query(
    "r10_approval_timeouts",
    finding_sql("approval-timeouts", "'medium'", "'approval-timeouts:' || workflow_name || ':' || step_id",
                f"'Approval ''' || step_id || ''' times out ' || {pct_sql('timed_out / fin::DOUBLE')} || ' of the time'",
                f"SELECT * FROM {GATES} WHERE fin >= 10 AND timed_out / fin::DOUBLE >= 0.2"),
)
def r10(h):
    return show(fd.approval_timeouts(facts(h), LOOSE))


R11 = finding_sql(
    "shell-sunset", "CASE WHEN days < 0 THEN 'high' ELSE 'medium' END", "'shell-sunset:' || workflow || ':' || step_id",
    "CASE WHEN days < 0 THEN 'Shell step ''' || step_id || ''' is ' || (-days) || ' days past its sunset date' ELSE 'Shell step ''' || step_id || ''' reaches its sunset date in ' || days || ' days' END",
    "SELECT *, date_diff('day', DATE '2001-08-02', sunset) AS days FROM plan_steps WHERE sunset IS NOT NULL AND date_diff('day', DATE '2001-08-02', sunset) <= 30", workflow="workflow")


@query("r11_shell_sunset", R11)
def r11(h):
    return show(fd.shell_sunsets(facts(h), T))


TIMED = "SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rk FROM runs WHERE NOT dry_run AND created_at >= TIMESTAMP '1997-06-24 00:00:00'"


def p_sql(keys, ms):
    return f"""SELECT {keys}, n, max(ms) FILTER (rn = {rank_sql(95)}) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms) AS rn, count(*) OVER (PARTITION BY {keys}) AS n
FROM (SELECT {keys}, {ms} AS ms FROM ({TIMED})) WHERE ms IS NOT NULL) GROUP BY {keys}, n"""


R12 = finding_sql(
    "schedule-drift", "CASE WHEN p95 >= 300000 THEN 'high' ELSE 'medium' END", "'schedule-drift:' || workflow_name", f"'''' || workflow_name || ''' starts ' || {human_sql('p95')} || ' late (p95)'",
    f"SELECT * FROM ({p_sql('tenant_id, workflow_name', 'CASE WHEN started_at IS NOT NULL AND scheduled_for IS NOT NULL THEN greatest(0, epoch_ms(started_at) - epoch_ms(scheduled_for)) END')}) WHERE n >= 5 AND p95 >= 60000", step=None)


@query("r12_schedule_drift", R12)
def r12(h):
    return show(fd.schedule_drift(facts(h), T))


R13 = finding_sql(
    "queue-starvation", "'medium'", "'queue-starvation'", f"'Runs wait ' || {human_sql('p95')} || ' for a slot (p95)'",
    f"SELECT * FROM ({p_sql('tenant_id', 'epoch_ms(started_at) - epoch_ms(created_at)')}) WHERE n >= 20 AND p95 >= 120000", workflow=None, step=None)


@query("r13_queue_starvation", R13)
def r13(h):
    return show(fd.queue_starvation(facts(h), T))


R14 = finding_sql(
    "unexercised-compensation", "'info'", "'unexercised-compensation:' || workflow_name", "'Compensation in ''' || workflow_name || ''' has never run'",
    """SELECT r.tenant_id, r.workflow_name FROM ({}) r JOIN plan_steps p ON p.tenant_id = r.tenant_id AND p.workflow = r.workflow_name AND p.has_compensation
LEFT JOIN ({}) s ON s.tenant_id = p.tenant_id AND s.workflow_name = p.workflow AND s.step_id = p.step_id WHERE total >= {} GROUP BY 1, 2
HAVING coalesce(max(compensated + compensation_failed), 0) = 0""", step=None)


@query("r14_unexercised_compensation", R14.format(RUNS.replace("1997-06-24", "2001-07-23"), STATS.replace("1997-06-24", "2001-07-23"), 2))
def r14(h):
    return show(fd.unexercised_compensation(facts(h, 10), fd.Thresholds(compensation_min_runs=2)))


R15 = finding_sql(
    "idle-workflow", "'medium'", "'idle-workflow:' || name", "'Scheduled workflow ''' || name || ''' has not run in 1 days'",
    """SELECT s.tenant_id, s.name FROM settings s JOIN plan_steps p ON p.tenant_id = s.tenant_id AND p.workflow = s.name AND p.scheduled
WHERE s.enabled AND NOT s.killed AND s.active_since <= TIMESTAMP '2001-08-01 12:00:00' AND NOT EXISTS
 (SELECT 1 FROM runs r WHERE r.tenant_id = s.tenant_id AND r.workflow_name = s.name AND NOT r.dry_run AND r.created_at >= TIMESTAMP '2001-08-01 00:00:00')""", workflow="name", step=None)


@query("r15_idle_workflow", R15)
def r15(h):
    return show(fd.idle_workflows(facts(h, 1), T))


def placed(f):
    from pyspark.sql import Window as W

    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"high": 0, "medium": 1, "low": 2, "info": 3}.items() for x in kv]), F.col("severity"))
    return f.withColumn("place", F.row_number().over(W.partitionBy("tenant_id").orderBy(rank, F.collate("key", "UNICODE"))))


ALL_VIEWS = {**DUP_VIEWS, "dtok": "SELECT tenant_id, workflow, capability AS token FROM plan_steps"}  # no capability comes twice in a plan here
R05 = finding_sql("duplicate-workflows", "'medium'", "'duplicate-workflows:' || x || ':' || y", "'''' || x || ''' and ''' || y || ''' are near-duplicates'", "SELECT * FROM dpair", workflow="x", step=None)
R08 = finding_sql(
    "approval-rubber-stamp", "'low'", "'approval-rubber-stamp:' || workflow_name || ':' || step_id", "'Approval ''' || step_id || ''' was approved ' || approved || ' times out of ' || approved",
    f"SELECT * FROM {GATES} WHERE denied = 0 AND timed_out = 0 AND approved >= 10")
R09 = finding_sql(
    "approval-often-denied", "'medium'", "'approval-often-denied:' || workflow_name || ':' || step_id", f"'Approval ''' || step_id || ''' is denied ' || {pct_sql('denied / fin::DOUBLE')} || ' of the time'",
    f"SELECT * FROM {GATES} WHERE fin >= 10 AND denied / fin::DOUBLE >= 0.24")
R10 = finding_sql(
    "approval-timeouts", "'medium'", "'approval-timeouts:' || workflow_name || ':' || step_id", f"'Approval ''' || step_id || ''' times out ' || {pct_sql('timed_out / fin::DOUBLE')} || ' of the time'",
    f"SELECT * FROM {GATES} WHERE fin >= 10 AND timed_out / fin::DOUBLE >= 0.2")
R15_WIDE = finding_sql(
    "idle-workflow", "'medium'", "'idle-workflow:' || name", "'Scheduled workflow ''' || name || ''' has not run in 1500 days'",
    """SELECT s.tenant_id, s.name FROM settings s JOIN plan_steps p ON p.tenant_id = s.tenant_id AND p.workflow = s.name AND p.scheduled
WHERE s.enabled AND NOT s.killed AND s.active_since <= TIMESTAMP '2001-08-02 00:00:00' - to_days(750) AND NOT EXISTS
 (SELECT 1 FROM runs r WHERE r.tenant_id = s.tenant_id AND r.workflow_name = s.name AND NOT r.dry_run AND r.created_at >= TIMESTAMP '1997-06-24 00:00:00')""", workflow="name", step=None)
FIFTEEN = " UNION ALL ".join(f"({x})" for x in (R01, R02, R03.format(STATS, 2 * LOOSE.min_samples), R04, R05, R06, R07, R08, R09, R10, R11, R12, R13, R14.format(RUNS, STATS, LOOSE.compensation_min_runs), R15_WIDE))


R17 = f"""WITH f AS (SELECT tenant_id, key FROM ({FIFTEEN})),
p AS (SELECT tenant_id, key, bool_or(status = 'open') AS is_open, max(created_at) FILTER (status = 'open') AS opened,
  bool_or(status <> 'open' AND decided_by <> 'analysis' AND decided_at > TIMESTAMP '2001-08-02 00:00:00' - CASE WHEN status = 'accepted' THEN to_days(14) ELSE to_days(30) END) AS cooling FROM proposals GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(f.tenant_id, p.tenant_id) AS tenant_id, coalesce(f.key, p.key) AS key,
  CASE WHEN f.key IS NOT NULL AND coalesce(is_open, false) THEN 'suppress-open' WHEN f.key IS NOT NULL AND coalesce(cooling, false) THEN 'suppress-cooling' WHEN f.key IS NOT NULL THEN 'raise'
   WHEN is_open AND opened <= TIMESTAMP '2001-08-01 00:00:00' THEN 'resolve' WHEN is_open THEN 'keep' END AS action
FROM f FULL OUTER JOIN p ON p.tenant_id = f.tenant_id AND p.key = f.key) WHERE action IS NOT NULL"""
K08 = f"SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, key) AS place FROM ({FIFTEEN})"


# all 15 rules, one window, one set of thresholds
@query("r16_analyse", FIFTEEN, extra=ALL_VIEWS)
@query("r18_analyse_all_rules", FIFTEEN, extra=ALL_VIEWS)
def r18(h):
    return show(rk.by_severity(fd.analyse(facts(h).written(), LOOSE)))


@query("r17_reconcile", R17, extra=ALL_VIEWS)
@query("r19_reconcile_all_rules", R17, extra=ALL_VIEWS)
def r19(h):
    return fd.reconcile(fd.analyse(facts(h).written(), LOOSE), h.proposals, ts(RUNS_AS_OF)).select("tenant_id", "key", "action")


@query("k08_severity_order", K08, extra=ALL_VIEWS)
@query("k20_severity_order_all_rules", K08, extra=ALL_VIEWS)
def k20(h):
    return placed(show(fd.analyse(facts(h).written(), LOOSE)))


@query(
    "j15_shared_fingerprints",
    """SELECT tenant_id, x, y, shared, un AS "union" FROM dcross""",
    extra=DUP_VIEWS,
)
def j15(h):
    shapes = sim.shapes_of(sim.step_bags(order_workflows(h)))
    return sim.similar_shapes(shapes, 0.8).select("tenant_id", F.least("ax", "ay").alias("x"), F.greatest("ax", "ay").alias("y"), "shared", "union")


@query(
    "u04_custom_rule",
    f"SELECT 'never-cheap' AS rule, 'low' AS severity, tenant_id, workflow_name AS workflow, CAST(NULL AS VARCHAR) AS step_id, 'never-cheap:' || workflow_name AS key, workflow_name || ' is never cheap' AS title FROM ({RUNS}) WHERE cost / total > 250000",
)
def u04(h):
    def never_cheap(f, t):
        w = f.workflows.where("total > 0 AND cost / total > 250000")
        none = F.lit(None).cast("string")
        wf = F.col("workflow_name")
        return w.select(
            F.lit("never-cheap").alias("rule"), F.lit("low").alias("severity"), "tenant_id", wf.alias("workflow"), none.alias("step_id"),
            F.concat(F.lit("never-cheap:"), wf).alias("key"), F.concat(wf, F.lit(" is never cheap")).alias("title"),
            none.alias("summary"), none.alias("recommendation"), F.to_json(F.struct("cost", "total")).alias("evidence"))

    return show(fd.analyse(facts(h), T, {"never-cheap": never_cheap}))
