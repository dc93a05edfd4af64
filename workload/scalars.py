"""Queries: the expression functions as column helpers, over whole tables."""

from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.plans.definitions import sensitivity_name, sensitivity_rank
from workload.registry import query

C = F.col


def customer(h):
    return h.raw("customer")


def words(h):
    """The words of a customer's name and segment, a number list and a map, per customer."""
    c = customer(h)
    return c.withColumn("ws", F.split(F.lower(F.concat_ws(" ", "c_mktsegment", "c_name", "c_mktsegment")), " ")).withColumn(
        "ns", F.array(C("c_acctbal"), C("c_nationkey").cast("double"), C("c_custkey").cast("double"))).withColumn(
        "m", F.create_map(F.lit("seg"), C("c_mktsegment"), F.lit("bal"), C("c_acctbal").cast("string"), F.lit("name"), C("c_name")))


WORDS = "SELECT *, string_split(lower(c_mktsegment || ' ' || c_name || ' ' || c_mktsegment), ' ') AS ws, [c_acctbal, CAST(c_nationkey AS DOUBLE), CAST(c_custkey AS DOUBLE)] AS ns FROM customer"


def reg(name, sql, fn):
    query(name, sql)(fn)


# documents: 'n' is the length in characters; the texts stay in the basic plane
reg("x01_len", f"SELECT doc_id, length(text) AS n, 3 AS items FROM documents",
    lambda h: h.raw("documents").select("doc_id", v.length_of_text(C("text")).cast("bigint").alias("n"), v.length_of(F.array(C("text"), C("lang"), C("source"))).alias("items")))
reg("x02_lower", "SELECT doc_id, sha256(lower(text)) AS t FROM documents", lambda h: h.raw("documents").select("doc_id", F.sha2(v.lower("text"), 256).alias("t")))
reg("x03_upper", "SELECT c_custkey, upper(c_name) AS t FROM customer", lambda h: customer(h).select("c_custkey", v.upper("c_name").alias("t")))
reg("x04_trim", "SELECT conv_id, turn, regexp_replace(regexp_replace(chr(9) || '  ' || text || ' ' || chr(10), '^\\s+', ''), '\\s+$', '') AS t FROM conversations",
    lambda h: h.raw("conversations").select("conv_id", "turn", v.trim(F.concat(F.lit("\t  "), C("text"), F.lit(" \n"))).alias("t")))
reg("x05_contains", f"SELECT c_custkey, contains(c_name, '9') AS in_text, list_contains(ws, 'building') AS in_list FROM ({WORDS})",
    lambda h: words(h).select("c_custkey", v.contains_text(C("c_name"), F.lit("9")).alias("in_text"), v.contains_item(C("ws"), F.lit("building")).alias("in_list")))
reg("x06_starts_with", "SELECT event_id, starts_with(event_type, 'c') AS hit FROM events", lambda h: h.raw("events").select("event_id", v.starts_with(C("event_type"), F.lit("c")).alias("hit")))
reg("x07_ends_with", "SELECT event_id, ends_with(event_type, 'k') AS hit FROM events", lambda h: h.raw("events").select("event_id", v.ends_with(C("event_type"), F.lit("k")).alias("hit")))
reg("x08_join", "SELECT c_custkey, c_name || '-' || coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') || '-x' AS t FROM customer",
    lambda h: customer(h).select("c_custkey", v.join(F.array(C("c_name"), F.when(C("c_acctbal") > 0, C("c_mktsegment")), F.lit("x")), "-").alias("t")))
reg("x09_split", "SELECT page_id, len(string_split(url, '/')) AS n, string_split(url, '.')[1] AS head FROM pages",
    lambda h: h.raw("pages").select("page_id", F.size(v.split(C("url"), "/")).cast("bigint").alias("n"), v.first(v.split(C("url"), ".")).alias("head")))
reg("x10_replace", "SELECT page_id, replace(url, '.', '$1') AS t FROM pages", lambda h: h.raw("pages").select("page_id", v.replace(C("url"), ".", "$1").alias("t")))
reg("x11_slice", f"SELECT c_custkey, substr(c_name, length(c_name) - 3, 3) AS a, substr(c_name, 3, 4) AS b, array_to_string(ws[2:3], ' ') AS c FROM ({WORDS})",
    lambda h: words(h).select("c_custkey", v.slice_text(C("c_name"), -4, -1).alias("a"), v.slice_text(C("c_name"), 2, 6).alias("b"), F.array_join(v.slice_items(C("ws"), 1, 3), " ").alias("c")))
reg("x12_keys", "SELECT c_custkey, 'bal,name,seg' AS k FROM customer", lambda h: words(h).select("c_custkey", F.array_join(v.keys(C("m")), ",").alias("k")))
reg("x13_values", "SELECT c_custkey, c_name || ',' || c_mktsegment AS t FROM customer", lambda h: words(h).select("c_custkey", F.array_join(v.slice_items(v.values(C("m")), 1), ",").alias("t")))
reg("x14_pluck", "SELECT c_custkey, c_name || '|none' AS t FROM customer",
    lambda h: words(h).select("c_custkey", F.array_join(F.transform(v.pluck(F.array(C("m"), F.create_map(F.lit("other"), F.lit("y"))), "name"), lambda x: F.coalesce(x, F.lit("none"))), "|").alias("t")))
reg("x15_first", f"SELECT c_custkey, ws[1] AS w FROM ({WORDS})", lambda h: words(h).select("c_custkey", v.first(C("ws")).alias("w")))
reg("x16_last", f"SELECT c_custkey, ws[-1] AS w FROM ({WORDS})", lambda h: words(h).select("c_custkey", v.last(C("ws")).alias("w")))
reg("x17_unique", f"SELECT c_custkey, ws[1] || ' ' || ws[2] AS t FROM ({WORDS})", lambda h: words(h).select("c_custkey", F.array_join(v.unique(C("ws")), " ").alias("t")))
reg("x18_sort", f"SELECT c_custkey, array_to_string(list_sort(ws), ' ') AS t, list_sort(ns)[1] AS low FROM ({WORDS})",
    lambda h: words(h).select("c_custkey", F.array_join(v.sort(C("ws")), " ").alias("t"), v.first(v.sort(C("ns"))).alias("low")))
reg("x19_sum", "SELECT c_custkey, 0.0::DOUBLE + c_acctbal + c_nationkey + c_custkey AS s, 0.0::DOUBLE AS none FROM customer",
    lambda h: words(h).select("c_custkey", v.sum_of(C("ns")).alias("s"), v.sum_of(F.array().cast("array<double>")).alias("none")))
reg("x20_min", f"SELECT c_custkey, list_min(ns) AS n FROM ({WORDS})", lambda h: words(h).select("c_custkey", v.min_of("ns").alias("n")))
reg("x21_max", f"SELECT c_custkey, list_max(ns) AS n FROM ({WORDS})", lambda h: words(h).select("c_custkey", v.max_of("ns").alias("n")))
reg("x22_round", "SELECT c_custkey, floor(c_acctbal * 1.0 + 0.5) / 1.0 AS whole, floor(c_acctbal / 3 * 100.0 + 0.5) / 100.0 AS cents FROM customer",
    lambda h: customer(h).select("c_custkey", v.round_half_up(C("c_acctbal")).alias("whole"), v.round_half_up(C("c_acctbal") / 3, 2).alias("cents")))
reg("x23_floor_ceil_abs", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS a FROM customer",
    lambda h: customer(h).select("c_custkey", v.floor("c_acctbal").alias("f"), v.ceil("c_acctbal").alias("c"), v.abs_("c_acctbal").alias("a")))
reg("x24_to_number", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS bad FROM events",
    lambda h: h.raw("events").select("event_id", v.to_number(F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit("\n"))).alias("n"), v.to_number(C("event_type"), strict=False).alias("bad")))
reg("x25_to_text_to_json", "SELECT event_id, CAST(user_id AS VARCHAR) AS t, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS js FROM events",
    lambda h: h.raw("events").select("event_id", v.to_text(C("user_id")).alias("t"), v.to_json(C("props")).alias("js")))
reg("x26_from_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS bad_is_null FROM events",
    lambda h: h.raw("events").select("event_id", F.variant_get(v.from_json(C("props")), "$.k", "bigint").alias("k"), v.from_json(F.concat(C("props"), F.lit("}")), strict=False).isNull().alias("bad_is_null")))
reg("x27_is_null", "SELECT id, finished_at IS NULL AS hit FROM runs", lambda h: h.runs.select("id", v.is_null("finished_at").alias("hit")))
reg("x28_hash", "SELECT doc_id, sha256(text) AS t, sha256('{\"a\":' || doc_id || ',\"b\":1}') AS j FROM documents",
    lambda h: h.raw("documents").select("doc_id", v.hash_text(C("text")).alias("t"), v.hash_json(F.concat(F.lit('{"b": 1, "a": '), C("doc_id"), F.lit("}"))).alias("j")))
reg("x29_uuid",
    """SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || (['8','9','a','b'])[CAST(CAST('0x' || substr(h, 17, 1) AS INT) % 4 AS INT) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u
FROM (SELECT o_orderkey, sha256('uuid:' || o_orderkey || ':' || o_orderstatus) AS h FROM orders)""",
    lambda h: h.raw("orders").select("o_orderkey", v.uuid_of(C("o_orderkey").cast("string"), C("o_orderstatus")).alias("u")))
reg("x30_date_add", "SELECT event_id, epoch_us(ts) // 1000 + event_id * 1500 AS ms FROM events",
    lambda h: h.events.select((C("seq") - 1).alias("event_id"), F.unix_millis(v.date_add_ms(C("ts"), (C("seq") - 1) * 1500)).alias("ms")))
reg("x31_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events", lambda h: h.events.select((C("seq") - 1).alias("event_id"), v.day_of("ts").cast("string").alias("d")))
reg("x32_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events", lambda h: h.events.select((C("seq") - 1).alias("event_id"), v.epoch_ms("ts").alias("ms")))
reg("x33_operators",
    """SELECT id, coalesce(finished_at < started_at, false) AS lt, parent_run_id IS NOT DISTINCT FROM NULL AS eq, cost / (k + 1)::DOUBLE AS div, (-(k + 1.0::DOUBLE)) % 7 AS mod,
 CASE WHEN dry_run THEN canary ELSE dry_run END AS both, CASE WHEN dry_run THEN dry_run ELSE canary END AS either, CASE WHEN k % 3 < 2 THEN k % 3 END AS idx FROM runs""",
    lambda h: h.runs.select("id", v.compare(C("finished_at"), "<", C("started_at")).alias("lt"), v.equals(C("parent_run_id"), F.lit(None)).alias("eq"), v.divide(C("cost"), C("k") + 1).alias("div"),
                            v.modulo(-(C("k") + 1.0), F.lit(7)).alias("mod"), v.both(C("dry_run"), C("canary")).alias("both"), v.either(C("dry_run"), C("canary")).alias("either"),
                            v.index(F.array(F.lit(0), F.lit(1)), (C("k") % 3).cast("int")).cast("bigint").alias("idx")))
reg("x34_truthiness", "SELECT id, coalesce(parent_run_id <> '', false) AS t, priority <> 0 AS n, dry_run AS b FROM runs",
    lambda h: h.runs.select("id", v.truthy_text(C("parent_run_id")).alias("t"), v.truthy_number(C("priority")).alias("n"), v.truthy(C("dry_run")).alias("b")))
reg("x35_render", "SELECT id, 'Run ' || id || ' of ' || workflow_name || ' is ' || status || ' ${{ raw }}' AS t, cost AS same FROM runs",
    lambda h: h.runs.select("id", v.render("Run ${{ id }} of ${{ wf }} is ${{ st }} $${{ raw }}", id=C("id"), wf=C("workflow_name"), st=C("status")).alias("t"), v.render("${{ cost }}", cost=C("cost")).alias("same")))
reg("x36_durations",
    """SELECT id, k % 50 * 3600000 + k % 60 * 60000 AS ms, (k % 7) * 86400000 + (k % 5) * 1000 AS iso_ms,
 CASE WHEN s = 0 THEN '0ms' ELSE CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' ELSE '' END || CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || 'h' ELSE '' END || CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60) || 's' ELSE '' END END AS t
FROM (SELECT id, k, k * 97 AS s FROM runs)""",
    lambda h: h.runs.select("id", v.duration_ms(F.concat((C("k") % 50).cast("string"), F.lit("h"), (C("k") % 60).cast("string"), F.lit("m"))).alias("ms"),
                            v.duration_ms(F.concat(F.lit("P"), (C("k") % 7).cast("string"), F.lit("DT"), (C("k") % 5).cast("string"), F.lit("S"))).alias("iso_ms"), v.duration_text(C("k") * 97_000).alias("t")))
reg("x37_canonical_hash", "SELECT c_custkey, 'sha256:' || sha256('{\"a\":[true,null],\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS h FROM customer",
    lambda h: customer(h).select("c_custkey", F.concat(F.lit("sha256:"), v.hash_json(F.concat(F.lit('{"name": "'), C("c_name"), F.lit('", "key": '), C("c_custkey").cast("string"), F.lit('.0, "a": [true, null]}')))).alias("h")))
reg("x38_orders",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS a, CASE WHEN c_nationkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'Box' END AS b FROM customer)
SELECT c_custkey, a < b AS code, CASE WHEN lower(a) <> lower(b) THEN lower(a) < lower(b) ELSE a > b END AS locale FROM n""",
    lambda h: customer(h).withColumn("a", F.expr("CASE WHEN c_nationkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END")).withColumn("b", F.expr("CASE WHEN c_nationkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'Box' END")).select(
        "c_custkey", (v.code_unit_key(C("a")) < v.code_unit_key(C("b"))).alias("code"), (v.locale_key(C("a")) < v.locale_key(C("b"))).alias("locale")))
reg("x39_sensitivity", "SELECT tenant_id, plan_hash, (['public','internal','confidential','secret'])[max(sens_rank) + 1] AS top FROM order_plans GROUP BY 1, 2",
    lambda h: h.order_plans.groupBy("tenant_id", "plan_hash").agg(sensitivity_name(F.max(sensitivity_rank(C("sensitivity")))).alias("top")))
