"""Queries: reading, listing and exporting."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import ranking as rk
from tidemark.session import shared_dir
from tidemark.sources import exports as ex
from tidemark.sources import external as xt
from tidemark.sources import history as hs
from workload.aggregates import ACTIVE, DURATIONS
from workload.alerts import VERIFY, verified
from workload.registry import query
from workload.views import ts

C = F.col


@query("s01_read_history", "SELECT tenant_id, status, count(*) AS n FROM runs GROUP BY 1, 2")
def s01(h):
    from tidemark.model import schema_of

    path = shared_dir(h.spark, "history")
    have = h.runs
    cols = [(C(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of("runs").fields]
    have.select(*cols).write.parquet(f"{path}/runs")
    return hs.read_history(h.spark, path, ["runs"])["runs"].groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


@query("s02_list_runs", "SELECT id, status FROM runs WHERE tenant_id = 'BUILDING' AND status IN ('failed','cancelled') AND created_at >= TIMESTAMP '1996-01-01' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 50")
def s02(h):
    return hs.list_runs(h.runs, 100, 50, tenant="BUILDING", status=["failed", "cancelled"], since=ts("1996-01-01 00:00:00")).select("id", "status")


@query("s03_count_runs", "SELECT count(*) AS n FROM runs WHERE workflow_name = '1-URGENT' AND trigger_type = 'schedule' AND created_at < TIMESTAMP '2000-01-01'")
def s03(h):
    return hs.count_runs(h.runs, workflow="1-URGENT", trigger_type="schedule", before=ts("2000-01-01 00:00:00"))


@query("s04_list_events", "SELECT seq, type FROM hist_events WHERE tenant_id = 't1' AND type IN ('step.failed','run.started') AND seq > 100 AND seq < 100000 ORDER BY seq DESC LIMIT 1000")
def s04(h):
    return hs.list_events(h.events, tenant="t1", types=["step.failed", "run.started"], after_seq=100, before_seq=100000, order="desc", limit=1000).select("seq", "type")


@query(
    "s06_audit_lines",
    f"""WITH v AS ({VERIFY}) SELECT tenant_id, CAST(0 AS BIGINT) AS seq, CAST(checked AS VARCHAR) AS mark FROM v UNION ALL SELECT tenant_id, seq, hash FROM chained_events""",
)
def s06(h):
    e = h.chained_events.select("seq", "id", "tenant_id", "ts", "type", "run_id", "data", "prev_hash", "hash")
    lines = ex.audit_lines(e, verified(h), ts("2024-01-31 00:00:00"))
    mark = F.coalesce(F.get_json_object("line", "$._meta.chain.checked"), F.get_json_object("line", "$.hash"))
    return lines.select("tenant_id", "seq", mark.alias("mark"))


@query(
    "s07_account_lines",
    """WITH x AS (SELECT t.id AS tenant_id, 5 AS fixed FROM tenants t), u AS (SELECT tenant_id, count(*) AS n FROM users GROUP BY 1), r AS (SELECT tenant_id, count(*) AS n, count(DISTINCT workflow_name) AS w, count(DISTINCT (workflow_name, workflow_version)) AS v FROM account_runs GROUP BY 1)
SELECT x.tenant_id, CAST(4 + coalesce(u.n, 0) + coalesce(r.n, 0) + 2 * coalesce(r.w, 0) + coalesce(r.v, 0) AS BIGINT) AS lines,
  CAST(greatest(coalesce(u.n, 0) - 1, 0) + greatest(coalesce(r.n, 0) - 1, 0) + greatest(coalesce(r.w, 0) - 1, 0) + coalesce(r.v - r.w, 0) AS BIGINT) AS commas
FROM x LEFT JOIN u ON u.tenant_id = x.tenant_id LEFT JOIN r ON r.tenant_id = x.tenant_id""",
)
def s07(h):
    versions = h.account_runs.groupBy("tenant_id", C("workflow_name").alias("name"), C("workflow_version").alias("version")).agg(F.min("created_at").alias("published_at"))
    settings = versions.groupBy("tenant_id", "name").agg(F.max("version").alias("stable_version"))
    lines = ex.account_lines(h.tenants, h.users, settings, versions, h.account_runs, ts("2024-01-31 00:00:00"))
    return lines.groupBy("tenant_id").agg(F.count("*").alias("lines"), F.count_if(C("line").startswith(",")).alias("commas"))


@query("s08_query_source", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def s08(h):
    h.raw("orders").createOrReplaceTempView("orders_source")
    rows, _ = xt.query_source(h.spark, "SELECT o_orderstatus AS status, count(*) AS n FROM orders_source WHERE o_totalprice > :floor GROUP BY 1;", {"floor": 100000})
    return rows


@query("s08_query_summary", "SELECT count(*) AS row_count, count(*) > 1000 AS truncated, least(count(*), 1000) AS returned FROM orders WHERE o_totalprice > 100000")
def s08b(h):
    """The summary tells of all rows, those returned are the first thousand."""
    h.raw("orders").createOrReplaceTempView("orders_source")
    rows, summary = xt.query_source(h.spark, "SELECT o_orderkey FROM orders_source WHERE o_totalprice > :floor", {"floor": 100000}, max_rows=1000)
    told = summary.select("row_count", "truncated", F.lit(None).cast("bigint").alias("returned"))
    both = told.unionByName(rows.agg(F.count("*").alias("returned")), allowMissingColumns=True)
    return both.agg(F.max("row_count").alias("row_count"), F.bool_or("truncated").alias("truncated"), F.max("returned").alias("returned"))


@query(
    "s09_apply_once",
    """SELECT idempotency_key, seq, value FROM (SELECT user_id || '/' || json_extract_string(props, '$.k') AS idempotency_key, seq, value, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY seq) AS rn FROM hist_events WHERE event_type <> 'error') e
WHERE rn = 1 AND idempotency_key NOT IN (SELECT user_id || '/' || json_extract_string(props, '$.k') FROM hist_events WHERE event_type = 'error')""",
)
def s09(h):
    e = h.events.withColumn("idempotency_key", F.concat_ws("/", "user_id", F.get_json_object("props", "$.k")))
    cols = ["idempotency_key", "seq", "value"]
    return xt.apply_once(e.where("event_type <> 'error'").select(*cols), e.where("event_type = 'error'").select("idempotency_key"))


@query(
    "s09_once_stream",
    """SELECT idempotency_key, seq, value FROM (SELECT user_id || '/' || json_extract_string(props, '$.k') AS idempotency_key, seq, value, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY seq) AS rn FROM hist_events) e WHERE rn = 1""",
)
def s09s(h):
    from tidemark.streaming import runtime as rt
    from workload.streams import stream

    e = stream(h).withColumn("idempotency_key", F.concat_ws("/", "user_id", F.get_json_object("props", "$.k"))).select("idempotency_key", "seq", "value")
    base = rt.run_each(e, "once", lambda at: xt.once_writer(f"{at}/table", f"{at}/keys"))
    return h.spark.read.schema(f"{e.schema.toDDL()}, batch bigint").parquet(f"{base}/table").drop("batch")


FILES = "SELECT c_nationkey AS nation, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1"


def name_files(h):
    """Folder with one text file per nation that lists its customers."""
    folder = shared_dir(h.spark, "name-files")
    c = h.raw("customer").select("c_nationkey", "c_custkey", C("c_name").alias("value"))
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.mode("append").partitionBy("c_nationkey").text(folder)
    return folder


def nation_of(path):
    return F.regexp_extract(path, r"c_nationkey=(\d+)/", 1).cast("bigint").alias("nation")


@query("s10_list_files", f"SELECT CAST(nation AS BIGINT) AS nation, 'file' AS type, CAST(strlen(body) AS BIGINT) AS size FROM ({FILES})")
def s10(h):
    return xt.list_files(h.spark, name_files(h), recursive=True, glob="*.txt").select(nation_of("path"), "type", C("size").cast("bigint").alias("size"))


@query("s11_read_files", f"SELECT CAST(nation AS BIGINT) AS nation, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256, md5(body) AS text_md5 FROM ({FILES})")
def s11(h):
    f = xt.read_files(h.spark, name_files(h), recursive=True, glob="*.txt")
    return f.select(nation_of("path"), C("size").cast("bigint").alias("size"), "sha256", F.md5("content").alias("text_md5"))


@query(
    "s12_put_content",
    """WITH b AS (SELECT tenant_id, hash, min(size) AS size FROM artifacts GROUP BY 1, 2), s AS (SELECT tenant_id, hash, bool_or(tombstoned_at IS NULL) AS alive FROM artifacts a JOIN documents d ON d.doc_id = a.doc_id WHERE d.lang = 'en' GROUP BY 1, 2)
SELECT b.tenant_id, b.hash, b.size, s.alive IS NOT NULL AS revived FROM b LEFT JOIN s ON s.tenant_id = b.tenant_id AND s.hash = b.hash WHERE s.alive IS NULL OR NOT s.alive""",
)
def s12(h):
    d = h.raw("documents")
    blobs = d.select(F.expr("concat('t', doc_id % 5)").alias("tenant_id"), C("text").alias("content"), F.lit("text/plain").alias("content_type"), F.lit(None).cast("string").alias("run_id"))
    stored = h.artifacts.join(d.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return xt.put_content(blobs, stored, ts("2024-01-31 00:00:00")).select("tenant_id", "hash", "size", "revived")


@query(
    "s13_prometheus_lines",
    f"""WITH g AS (SELECT tenant_id, count(*) FILTER (status IN {ACTIVE}) AS n FROM runs GROUP BY 1), d AS (SELECT tenant_id, ms FROM ({DURATIONS}))
SELECT '# HELP active_runs Runs now.' AS line UNION ALL SELECT '# TYPE active_runs gauge' UNION ALL SELECT 'active_runs{{tenant="' || tenant_id || '"}} ' || n FROM g
UNION ALL SELECT 'run_ms_count{{tenant="' || tenant_id || '"}} ' || count(*) FROM d GROUP BY tenant_id
UNION ALL SELECT 'run_ms_sum{{tenant="' || tenant_id || '"}} ' || CAST(sum(ms) AS BIGINT) FROM d GROUP BY tenant_id
UNION ALL SELECT 'run_ms_bucket{{tenant="' || tenant_id || '",le="' || le || '"}} ' || count(*) FILTER (ms <= bound) FROM d, (VALUES ('60000', 60000), ('600000', 600000), ('+Inf', 100000000000)) b(le, bound) GROUP BY tenant_id, le""",
)
def s13(h):
    labels = ex.labels_text(F.create_map(F.lit("tenant"), C("tenant_id")))
    g = ag.active_counts(h.runs, by_workflow=False).select(F.lit("active_runs").alias("metric"), labels.alias("labels"), C("active").cast("double").alias("value"))
    d = rk.durations(rk.run_timings(h.runs, cap=None)).withColumn("labels", labels)
    hist = ag.histogram(d.withColumn("duration_ms", C("duration_ms").cast("double")), ["labels"], "duration_ms", (60000, 600000))
    return ex.metric_lines(g, "gauge", "Runs now.").select("line").unionByName(ex.histogram_lines("run_ms", hist).select("line"))


@query(
    "s14_filtered_lists",
    """(SELECT 'approval' AS kind, id FROM approvals WHERE tenant_id = 'BUILDING' AND status = 'denied' ORDER BY requested_at DESC, id DESC LIMIT 100)
UNION ALL (SELECT 'proposal', id FROM proposals WHERE tenant_id = 'BUILDING' AND status = 'open' ORDER BY created_at DESC, id DESC LIMIT 200)
UNION ALL (SELECT 'delivery', id FROM deliveries WHERE tenant_id = 't2' ORDER BY event_seq DESC LIMIT 100)""",
)
def s14(h):
    def pick(kind, df):
        return df.select(F.lit(kind).alias("kind"), "id")

    a = hs.newest(h.approvals, "requested_at", 100, {"tenant_id": "BUILDING", "status": "denied"})
    p = hs.newest(h.proposals, "created_at", 200, {"tenant_id": "BUILDING", "status": "open"})
    d = hs.newest(h.deliveries, "event_seq", 100, {"tenant_id": "t2"})
    return pick("approval", a).unionByName(pick("proposal", p)).unionByName(pick("delivery", d))


@query("u03_map_items", "SELECT CAST(o_orderkey AS VARCHAR) AS id, idx AS index, CASE WHEN item > 0 THEN item * 2 END AS value, item > 0 AS ok FROM (SELECT o_orderkey, unnest([o_totalprice, CASE WHEN o_custkey % 100 = 0 THEN -1.0 ELSE 1.0 END, o_custkey + 1.0]) AS item, unnest([0, 1, 2]) AS idx FROM orders)")
def u03(h):
    def double(pdf: pd.DataFrame) -> pd.Series:
        if (pdf["item"] <= 0).any():
            raise ValueError("not positive")
        return pdf["item"] * 2

    o = h.raw("orders").select(C("o_orderkey").cast("string").alias("id"), F.array(C("o_totalprice"), F.when(C("o_custkey") % 100 == 0, -1.0).otherwise(1.0), C("o_custkey") + 1.0).alias("items"))
    return ex.map_items(o, "items", ["id"], double, "double").select("id", "index", "value", "ok")
