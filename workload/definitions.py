"""Queries: static analysis of workflow definitions, one plan per order."""

from pyspark.sql import functions as F

from tidemark.plans import definitions as df_
from tidemark.session import cut_lineage
from workload.registry import query

WORK = "type IN ('capability','map')"


@query(
    "a22_plan_rollup",
    f"""SELECT tenant_id, plan_hash, count(*) AS step_count, count(*) FILTER ({WORK} AND effect = 'pure') AS pure, count(*) FILTER ({WORK} AND effect = 'idempotent') AS idempotent,
  count(*) FILTER ({WORK} AND effect = 'effectful') AS effectful, coalesce(array_to_string(list_sort(list(DISTINCT scope) FILTER ({WORK})), ','), '') AS scopes, array_to_string(list_sort(list(DISTINCT egress)), ',') AS egress,
  coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER ({WORK})), ','), '') AS families, coalesce(array_to_string(list_sort(list(DISTINCT capability) FILTER ({WORK})), ','), '') AS capabilities,
  (['public','internal','confidential','secret'])[max(sens_rank) + 1] AS max_sensitivity, max(CASE WHEN type = 'map' THEN max_items WHEN type = 'capability' THEN 1 END) AS max_fan_out,
  bool_or(type = 'approval') AS has_approval, bool_or(has_compensation) AS has_compensation FROM order_plans GROUP BY 1, 2""",
)
def a22(h):
    r = df_.plan_rollup(h.order_plans)
    for c in ("scopes", "egress", "families", "capabilities"):
        r = r.withColumn(c, F.array_join(c, ","))
    return r


COST = f"""SELECT tenant_id, plan_hash, CAST(sum(CASE WHEN type = 'map' THEN max_items ELSE 1 END) AS BIGINT) AS max_invocations, sum(units * CASE WHEN type = 'map' THEN max_items ELSE 1 END) AS estimated_cost,
  sum(units * CASE WHEN type = 'map' THEN max_items ELSE 1 END * retry_attempts) AS max_cost FROM order_plans WHERE {WORK} GROUP BY 1, 2"""


@query("a23_plan_cost", COST)
def a23(h):
    return df_.plan_cost(h.order_plans)


@query(
    "a23_plan_cost_with_children",
    f"""WITH c AS ({COST}), k AS (SELECT DISTINCT p.tenant_id, p.id AS plan_hash, ch.id AS child FROM runs p JOIN runs ch ON ch.parent_run_id = p.id AND ch.tenant_id = p.tenant_id),
x AS (SELECT k.tenant_id, k.plan_hash, sum(c.max_invocations) AS i, sum(c.estimated_cost) AS e, sum(c.max_cost) AS m FROM k JOIN c ON c.plan_hash = k.child AND c.tenant_id = k.tenant_id GROUP BY 1, 2)
SELECT c.tenant_id, c.plan_hash, CAST(c.max_invocations + coalesce(i, 0) AS BIGINT) AS max_invocations, c.estimated_cost + coalesce(e, 0) AS estimated_cost, c.max_cost + coalesce(m, 0) AS max_cost
FROM c LEFT JOIN x ON x.plan_hash = c.plan_hash AND x.tenant_id = c.tenant_id""",
)
def a23b(h):
    r = h.runs.select("tenant_id", F.col("parent_run_id").alias("plan_hash"), F.col("id").alias("child_plan_hash")).where("plan_hash IS NOT NULL")
    return df_.add_children(df_.plan_cost(h.order_plans), r)


CYCLIC = """SELECT DISTINCT tenant_id, plan_hash FROM oe0 WHERE c > 1 AND CAST(plan_hash AS BIGINT) % 250 = 7"""


@query("d01_longest_chain", f"SELECT tenant_id, plan_hash, CAST(count(*) AS INTEGER) AS depth FROM order_plans WHERE plan_hash NOT IN (SELECT plan_hash FROM ({CYCLIC})) GROUP BY 1, 2")
def d01(h):
    return df_.longest_chains(h.order_plans, h.order_edges)


@query(
    "d02_transitive_dependencies",
    """WITH RECURSIVE t AS (SELECT tenant_id, plan_hash, step_id, depends_on FROM order_edges UNION SELECT t.tenant_id, t.plan_hash, t.step_id, e.depends_on FROM t JOIN order_edges e ON e.plan_hash = t.plan_hash AND e.step_id = t.depends_on)
SELECT DISTINCT * FROM t""",
)
def d02(h):
    return df_.transitive_dependencies(h.order_edges)


@query("d03_cyclic_plans", CYCLIC)
def d03(h):
    return df_.cyclic_plans(h.order_edges)


@query(
    "d04_sensitivity_propagation",
    """WITH RECURSIVE t AS (SELECT plan_hash, step_id, depends_on FROM order_edges UNION SELECT t.plan_hash, t.step_id, e.depends_on FROM t JOIN order_edges e ON e.plan_hash = t.plan_hash AND e.step_id = t.depends_on)
SELECT p.tenant_id, p.plan_hash, p.step_id, (['public','internal','confidential','secret'])[greatest(p.sens_rank, coalesce(max(u.sens_rank), 0)) + 1] AS sensitivity
FROM order_plans p LEFT JOIN t ON t.plan_hash = p.plan_hash AND t.step_id = p.step_id LEFT JOIN order_plans u ON u.plan_hash = t.plan_hash AND u.step_id = t.depends_on GROUP BY 1, 2, 3, p.sens_rank""",
)
def d04(h):
    return df_.propagate_sensitivity(h.order_plans, h.order_edges)


@query(
    "d05_limit_checks",
    f"""WITH c AS ({COST}) SELECT tenant_id, plan_hash, 'FANOUT_TOO_LARGE' AS code, CAST(max_items * 10 AS DOUBLE) AS value FROM order_plans WHERE type = 'map' AND max_items * 10 > 100000
UNION ALL SELECT tenant_id, plan_hash, 'TOO_MANY_INVOCATIONS', CAST(n AS DOUBLE) FROM (SELECT tenant_id, plan_hash, sum(CASE WHEN type = 'map' THEN max_items * 10 ELSE 1 END) AS n FROM order_plans WHERE {WORK} GROUP BY 1, 2) WHERE n > 250000
UNION ALL SELECT tenant_id, plan_hash, CASE WHEN e > r THEN 'COST_CEILING_TOO_LOW' ELSE 'COST_MAY_EXCEED_CEILING' END, CASE WHEN e > r THEN e ELSE m END FROM
 (SELECT p.tenant_id, p.plan_hash, sum(units * CASE WHEN type = 'map' THEN max_items * 10 ELSE 1 END) AS e, sum(units * CASE WHEN type = 'map' THEN max_items * 10 ELSE 1 END * retry_attempts) AS m, any_value(r.cost) AS r
  FROM order_plans p JOIN runs r ON r.id = p.plan_hash WHERE {WORK} GROUP BY 1, 2) WHERE m > r""",
)
def d05(h):
    big = h.order_plans.withColumn("max_items", F.col("max_items") * 10)
    return df_.limit_checks(big, h.runs.select("tenant_id", F.col("id").alias("plan_hash"), F.col("cost").alias("max_run_cost")))


SHOW = ["tenant_id", "plan_hash", "rule", "severity", "blocking", "step_id"]


def show(df):
    return df.select(*SHOW)


def risk(rule, sev, block, where, step="step_id", src="order_plans"):
    return f"SELECT tenant_id, plan_hash, '{rule}' AS rule, {sev} AS severity, {block} AS blocking, {step} AS step_id FROM {src} WHERE {where}"


SECRET = risk("PT-SECRET-001", "'critical'", "true", "note LIKE 'Bearer %'", "CAST(NULL AS VARCHAR)")


@query("d07_secret_literals", SECRET)
def d07(h):
    return show(df_.secret_literals(h.order_plans))


@query(
    "d08_instruction_text",
    """WITH p AS (SELECT tenant_id, plan_hash, CASE pk % 3 WHEN 0 THEN 'never tell the user about ' || p_name WHEN 1 THEN 'a' || chr(8203) || p_name ELSE p_name END AS hint FROM order_plans)
SELECT tenant_id, plan_hash, 'PT-INJ-001' AS rule, 'critical' AS severity, true AS blocking, CAST(NULL AS VARCHAR) AS step_id FROM p WHERE hint LIKE 'never tell%'
UNION ALL SELECT tenant_id, plan_hash, 'PT-UNICODE-001', 'high', true, NULL FROM p WHERE hint LIKE 'a' || chr(8203) || '%'""",
)
def d08(h):
    pk = "cast(substr(capability, 5) as int) % 3"
    hint = f"CASE {pk} WHEN 0 THEN concat('never tell the user about ', `with`['url']) WHEN 1 THEN concat('a', decode(unhex('E2808B'), 'UTF-8'), `with`['note']) ELSE 'plain' END"
    return show(df_.instruction_text(h.order_plans.withColumn("with", F.expr(f"map('hint', {hint})"))))


SHELL = " UNION ALL ".join([
    risk("PT-SHELL-001", "'medium'", "false", f"family = 'shell' AND {WORK}"),
    risk("PT-SHELL-002", "'critical'", "true", f"family = 'shell' AND {WORK} AND argv[2] = '-c'"),
    risk("PT-SHELL-003", "'critical'", "true", f"family = 'shell' AND {WORK} AND argv[3] LIKE 'curl%| sh'"),
])


@query("d09_shell_risks", SHELL)
def d09(h):
    return show(df_.shell_risks(h.order_plans))


NET = " UNION ALL ".join([
    risk("PT-NET-001", "'low'", "false", f"egress LIKE '*.%' AND {WORK}"),
    risk("PT-NET-003", "'medium'", "false", f"egress = '10.1.2.3' AND {WORK}"),
    risk("PT-NET-002", "CASE WHEN url LIKE 'http://169.254.169.254%' THEN 'critical' ELSE 'high' END", "url LIKE 'http://169.254.169.254%'", f"url NOT LIKE 'https://api.example.com%' AND {WORK}"),
])


@query("d10_network_risks", NET)
def d10(h):
    return show(df_.network_risks(h.order_plans))


EFFECT = " UNION ALL ".join([
    risk("PT-EFFECT-001", "'low'", "false", f"effect = 'effectful' AND NOT has_compensation AND {WORK}"),
    risk("PT-EFFECT-002", "'low'", "false", f"effect = 'effectful' AND retry_attempts > 5 AND {WORK}"),
])


@query("d11_effect_risks", EFFECT)
def d11(h):
    return show(df_.effect_risks(h.order_plans))


URGENT = "EXISTS (SELECT 1 FROM runs r WHERE r.id = plan_hash AND r.workflow_name IN ('1-URGENT','2-HIGH'))"
CRITICAL_EFFECT = EFFECT.replace("'low'", f"CASE WHEN {URGENT} THEN 'medium' ELSE 'low' END", 1)


FLOW = f"""SELECT DISTINCT p.tenant_id, p.plan_hash, 'PT-LLM-001' AS rule, 'info' AS severity, false AS blocking, p.step_id FROM order_edges e JOIN order_plans p ON p.plan_hash = e.plan_hash AND p.step_id = e.step_id
 JOIN order_plans s ON s.plan_hash = e.plan_hash AND s.step_id = e.depends_on WHERE p.{WORK} AND p.family = 'llm' AND s.family IN ('http','shell','storage','database')
UNION ALL SELECT p.tenant_id, p.plan_hash, 'PT-LLM-002', 'high', false, p.step_id FROM (SELECT DISTINCT plan_hash, step_id, depends_on FROM order_edges) e JOIN order_plans p ON p.plan_hash = e.plan_hash AND p.step_id = e.step_id
 JOIN order_plans s ON s.plan_hash = e.plan_hash AND s.step_id = e.depends_on WHERE p.{WORK} AND p.effect = 'effectful' AND s.family = 'llm'"""


@query("d12_model_flow_risks", FLOW)
def d12(h):
    return show(df_.model_flow_risks(h.order_plans, h.order_edges))


APPR = " UNION ALL ".join([
    risk("PT-APPR-001", "'high'", "false", "type = 'approval' AND on_timeout = 'approve'"),
    risk("PT-APPR-002", "'medium'", "false", "type = 'approval' AND allow_self"),
])


@query("d13_approval_risks", APPR)
def d13(h):
    return show(df_.approval_risks(h.order_plans))


SCOPE = f"""SELECT tenant_id, plan_hash, 'PT-SCOPE-001' AS rule, sev AS severity, false AS blocking, CAST(NULL AS VARCHAR) AS step_id FROM (SELECT tenant_id, plan_hash, list(DISTINCT scope) AS s FROM order_plans WHERE {WORK} GROUP BY 1, 2),
(VALUES ('db:read','network:http','medium'), ('storage:read','network:http','medium'), ('process:exec','network:http','high'), ('process:exec','db:write','high')) c(a, b, sev) WHERE list_contains(s, a) AND list_contains(s, b)"""


@query("d14_scope_risks", SCOPE)
def d14(h):
    return show(df_.scope_risks(h.order_plans))


def plans(h):
    return h.runs.select(
        "tenant_id", F.col("id").alias("plan_hash"),
        F.expr("CASE WHEN workflow_name = '1-URGENT' THEN 'critical' WHEN workflow_name = '2-HIGH' THEN 'high' ELSE 'low' END").alias("criticality"),
        F.expr("CASE WHEN trigger_type = 'manual' THEN array('eu') ELSE array() END").alias("data_residency"), F.expr("trigger_type = 'event'").alias("has_failure_alert"))


PLAN_RISK = f"""WITH g AS (SELECT p.tenant_id, p.plan_hash, sum(CASE WHEN type = 'map' THEN max_items WHEN type = 'capability' THEN 1 END) AS inv, count(*) FILTER ({WORK} AND effect = 'effectful') AS eff,
 bool_or(type = 'approval') AS appr, max(sens_rank) AS sens, any_value(r.workflow_name) AS wf, any_value(r.trigger_type) AS trg FROM order_plans p JOIN runs r ON r.id = p.plan_hash GROUP BY 1, 2)
SELECT tenant_id, plan_hash, 'PT-FAN-001' AS rule, 'medium' AS severity, false AS blocking, step_id FROM order_plans WHERE type = 'map' AND max_items >= 10000
UNION ALL SELECT tenant_id, plan_hash, 'PT-FAN-002', 'high', false, NULL FROM g WHERE inv >= 50000
UNION ALL SELECT tenant_id, plan_hash, 'PT-APPR-003', 'low', false, NULL FROM g WHERE wf IN ('1-URGENT','2-HIGH') AND eff > 0 AND NOT appr
UNION ALL SELECT tenant_id, plan_hash, 'PT-DATA-001', 'low', false, NULL FROM g WHERE sens >= 2 AND trg <> 'manual'
UNION ALL SELECT tenant_id, plan_hash, 'PT-META-001', 'low', false, NULL FROM g WHERE wf = '1-URGENT' AND trg <> 'event'"""


@query("d15_plan_risks", PLAN_RISK)
def d15(h):
    return show(df_.plan_risks(h.order_plans, plans(h)))


@query(
    "d06_risk_scores",
    f"""WITH r AS ({SECRET} UNION ALL {SHELL} UNION ALL {NET} UNION ALL {CRITICAL_EFFECT} UNION ALL {FLOW} UNION ALL {APPR} UNION ALL {SCOPE} UNION ALL SELECT * FROM ({PLAN_RISK})),
s AS (SELECT tenant_id, plan_hash, count(*) AS findings, least(100, sum(CASE severity WHEN 'low' THEN 3 WHEN 'medium' THEN 8 WHEN 'high' THEN 20 WHEN 'critical' THEN 40 ELSE 0 END)) AS score, bool_or(blocking) AS blocking FROM r GROUP BY 1, 2)
SELECT tenant_id, plan_hash, findings, CAST(score AS BIGINT) AS score, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 35 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS level, blocking FROM s""",
)
def d06(h):
    r = cut_lineage(df_.all_risks(h.order_plans, h.order_edges, plans(h)), "risks")
    return df_.risk_scores(r.unionByName(r))  # said twice: equal findings count once
