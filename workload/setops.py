"""Queries: set operations."""

from pyspark.sql import functions as F

from tidemark.functions import stats as st
from tidemark.operators import setops as so
from workload.registry import query

C = F.col


@query("o01_concat", "SELECT id, status FROM approvals WHERE status = 'denied' UNION ALL SELECT id, status FROM deliveries WHERE status = 'failed'")
def o01(h):
    return so.concat(h.approvals.where("status = 'denied'").select("id", "status"), h.deliveries.where("status = 'failed'").select("status", "id"))


@query(
    "o02_bag_overlap",
    """SELECT CAST(sum(least(l, r)) AS BIGINT) AS shared, CAST(sum(greatest(l, r)) AS BIGINT) AS "union" FROM (SELECT l_partkey, count(*) FILTER (l_suppkey % 2 = 0) AS l, count(*) FILTER (l_suppkey % 2 = 1) AS r FROM lineitem GROUP BY 1)""",
)
def o02(h):
    return so.bag_overlap(h.raw("lineitem").withColumn("side", C("l_suppkey") % 2), F.lit(0), F.lit(1), "side", "l_partkey")


@query(
    "o03_differing",
    """SELECT DISTINCT a.l_partkey FROM (SELECT l_partkey, min(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a JOIN (SELECT l_partkey, min(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b ON a.l_partkey = b.l_partkey WHERE a.q IS DISTINCT FROM b.q""",
)
def o03(h):
    side = lambda s: h.raw("lineitem").where(C("l_linestatus") == s).groupBy("l_partkey").agg(F.min("l_quantity").alias("q"))
    return so.differing(side("O"), side("F"), ["l_partkey"], "q")


@query("o04_removed", "SELECT id FROM triggers t WHERE NOT EXISTS (SELECT 1 FROM hooks h WHERE h.tenant_id = t.tenant_id AND replace(h.hook_id, 'hook-', 'trg-') = t.id)")
def o04(h):
    declared = h.hooks.select("tenant_id", F.expr("replace(hook_id, 'hook-', 'trg-')").alias("id"))
    return so.removed(h.triggers, declared, ["tenant_id", "id"]).select("id")


@query(
    "o05_insert_if_absent",
    """SELECT tenant_id, user_id, seq FROM (SELECT tenant_id, user_id, seq, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY seq) AS rn FROM hist_events WHERE value > 20 AND (tenant_id, user_id) NOT IN (SELECT (tenant_id, user_id) FROM hist_events WHERE value < 0.3)) WHERE rn = 1""",
)
def o05(h):
    cols = ["tenant_id", "user_id", "seq"]
    return so.insert_if_absent(h.events.where("value > 20").select(*cols), h.events.where("value < 0.3").select(*cols), ["tenant_id", "user_id"], "seq")


@query("o06_upsert_last", "SELECT tenant_id, user_id, arg_max(event_type, seq) AS event_type, max(seq) AS seq FROM hist_events GROUP BY 1, 2")
def o06(h):
    cols = ["tenant_id", "user_id", "event_type", "seq"]
    return so.upsert_last(h.events.where("event_type = 'view'").select(*cols), h.events.where("event_type <> 'view'").select(*cols), ["tenant_id", "user_id"], "seq")


@query("o06_upsert_sum", "SELECT tenant_id, floor(sum(value) * 100.0 + 0.5) / 100.0 AS value FROM hist_events GROUP BY 1")
def o06b(h):
    cols = ["tenant_id", "value"]
    u = so.upsert_sum(h.events.where("event_type = 'view'").select(*cols), h.events.where("event_type <> 'view'").select(*cols), ["tenant_id"], "value")
    return u.withColumn("value", st.half_up(C("value"), 2))
