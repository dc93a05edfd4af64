import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import nearest_rank, upper_median
from tidemark.operators import aggregates as ag
from tidemark.operators import joins as jn
from tidemark.operators import ranking as rk
from tidemark.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = []
    for i in range(3000):
        g = "hot" if rnd.random() < 0.6 else rnd.choice("abcdef")
        v = rnd.choice([0, 1, 5, 255, 256, 257, 511, 512, 1000, rnd.randrange(10**7), rnd.randrange(10**12)])
        data.append((i + 1, g, v))
    return spark.createDataFrame(data, "seq bigint, g string, v bigint").cache(), data


def test_lag_and_index_across_chunks(rows):
    df, _ = rows
    got = skew.chunked_lag(df, ["g"], "seq", {"v": "p"}, 100, index="i")
    w = W.partitionBy("g").orderBy("seq")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("i", F.row_number().over(w).cast("long"))
    cols = ["seq", "g", "v", "p", "i"]
    assert sorted(got.select(cols).collect(), key=lambda r: r.seq) == sorted(want.select(cols).collect(), key=lambda r: r.seq)


def test_running_sum_across_chunks(rows):
    df, _ = rows
    got = skew.chunked_running_sum(df, ["g"], "seq", F.col("v"), "s", 64)
    want = df.withColumn("s", F.sum("v").over(W.partitionBy("g").orderBy("seq")))
    assert {r.seq: r.s for r in got.collect()} == {r.seq: r.s for r in want.collect()}


def test_top_n_is_exact(rows):
    df, data = rows
    got = skew.top_n_per_group(df, ["g"], [F.desc("v"), F.desc("seq")], 50)
    want = {}
    for s, g, v in data:
        want.setdefault(g, []).append((v, s))
    want = {(g, s) for g, xs in want.items() for v, s in sorted(xs, reverse=True)[:50]}
    assert {(r.g, r.seq) for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 7, 200])
def test_newest_is_exact(spark, n):
    rnd = random.Random(6)
    data = [(f"r{i:04d}", rnd.choice(["hot", "hot", "b", None]), rnd.randrange(40_000)) for i in range(900)]
    df = spark.createDataFrame(data, "id string, g string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for i, g, s in data:
        want.setdefault(g, []).append((s, i))
    want = {(g, i) for g, xs in want.items() for s, i in sorted(xs, reverse=True)[:n]}
    assert {(r.g, r.id) for r in skew.newest_per_group(df, ["g"], "ts", "id", n).collect()} == want


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(None, 5), (None, 7), ("a", 1)], "g string, v bigint")
    got = {r.g: (r.n, r.m) for r in skew.ranked_values(df, ["g"], "v", {"m": upper_median()}).collect()}
    assert got == {None: (2, 7), "a": (1, 1)}


def test_ranked_values_match_sorting(rows):
    df, data = rows
    got = skew.ranked_values(df, ["g"], "v", {"p50": nearest_rank(50), "p95": nearest_rank(95), "p0": nearest_rank(0), "p100": nearest_rank(100), "med": upper_median()})
    groups = {}
    for _, g, v in data:
        groups.setdefault(g, []).append(v)
    for r in got.collect():
        xs = sorted(groups.pop(r.g))
        pick = lambda p: xs[min(len(xs) - 1, max(0, math.ceil(p / 100 * len(xs)) - 1))]
        assert (r.n, r.p50, r.p95, r.p0, r.p100, r.med) == (len(xs), pick(50), pick(95), xs[0], xs[-1], xs[len(xs) // 2])
    assert not groups


def test_nearest_rank_anchor(spark):
    df = spark.range(1, 21).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    r = skew.ranked_values(df, ["g"], "v", {"p95": nearest_rank(95), "p50": nearest_rank(50)}).first()
    assert (r.p95, r.p50) == (19, 10)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_nearest_names_match_brute_force(spark):
    rnd = random.Random(3)
    known = sorted({"".join(rnd.choice("abc-") for _ in range(rnd.randrange(1, 14))) for _ in range(150)})
    unknown = []
    for _ in range(200):
        s = list(rnd.choice(known))
        for _ in range(rnd.randrange(5)):
            op, at = rnd.randrange(3), rnd.randrange(len(s) + 1)
            if op == 0:
                s.insert(at, rnd.choice("abcX"))
            elif s and at < len(s):
                s[at : at + 1] = [] if op == 1 else [rnd.choice("abcx")]
        unknown.append("".join(s))
    k = spark.createDataFrame([(n, i) for i, n in enumerate(known)], "name string, position int")
    got = {r.unknown: (r.suggestion, r.distance) for r in jn.nearest_names(spark.createDataFrame([(u,) for u in unknown], "name string"), k).collect()}
    for u in set(unknown):
        d, i = min((edits(u.lower(), n.lower()), i) for i, n in enumerate(known))
        assert got.get(u) == ((known[i], d) if d <= max(2, len(u) // 3) else None), u


def test_short_names_meet_few_others(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4))
    known = sorted({word() for _ in range(10_000)})
    unknown = [word() for _ in range(300)] + ["", "a", None]
    u, k = spark.createDataFrame([(n,) for n in unknown], "name string"), spark.createDataFrame([(n, i) for i, n in enumerate(known)], "name string, position int")
    assert jn.name_candidates(u, k).count() < 0.08 * 300 * len(known)
    got = {r.unknown: (r.suggestion, r.distance) for r in jn.nearest_names(u, k).collect()}
    for n in unknown[:20] + ["", "a"]:
        d, i = min((edits(n, m), i) for i, m in enumerate(known))
        assert got.get(n) == ((known[i], d) if d <= 2 else None), n
    assert None not in got


def test_semver_order(spark):
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.10", "1.2.0", "10.0.0"]
    df = spark.createDataFrame([(v,) for v in random.Random(2).sample(versions, len(versions))], "v string")
    assert [r.v for r in df.orderBy(rk.semver_key(F.col("v"))).collect()] == versions


def test_waits_take_the_first_matching_event(spark):
    waits = spark.createDataFrame([("t", "r1", "s", "paid", "A"), ("t", "r2", "s", "paid", None), ("t", "r3", "s", "paid", "Z"), ("u", "r4", "s", "paid", None)], "tenant_id string, run_id string, step_id string, wait_event string, wait_correlation string")
    events = spark.createDataFrame([("t", "paid", "B", 1), ("t", "paid", "A", 2), ("t", "paid", "A", 3), ("t", "other", None, 4)], "tenant_id string, type string, correlation string, seq int")
    assert {r.run_id: r.seq for r in jn.resume_waits(waits, events).collect()} == {"r1": 2, "r2": 1}


def test_first_event_at_or_after(spark):
    rnd = random.Random(9)
    asks = [(i, rnd.choice("ab"), rnd.randrange(5000)) for i in range(300)]
    events = [(i, rnd.choice("abc"), rnd.randrange(5000)) for i in range(80)]
    a = spark.createDataFrame(asks, "ask int, k string, t bigint")
    e = spark.createDataFrame(events, "seq int, k string, at bigint")
    got = {r.ask: (r.at, r.seq) for r in skew.first_at_or_after(a, e, ["k"], "t", "at", ["seq"], bucket_ms=400).collect()}
    for ask, k, t in asks:
        assert got[ask] == min(((at, s) for s, ek, at in events if ek == k and at >= t), default=(None, None))


def test_chunked_running_and_walked_chains(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 1, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int")
    got = {r.seq: (r.upto, r.before) for r in skew.chunked_running(df, ["k"], "seq", {"upto": F.col("v")}, {"before": F.col("v")}, rows_per_chunk=40).collect()}
    for k, i, _ in rows:
        known = [(s, v) for g, s, v in rows if g == k and s <= i and v is not None]
        assert got[i] == (max((v for _, v in known), default=None), max((v for s, v in known if s < i), default=None))
    # a long chain, one that ends at once and a key without a start
    jump = spark.createDataFrame([("a", i, i + 3) for i in range(0, 200)] + [("b", 7, 8)], "k string, at bigint, _next bigint")
    starts = spark.createDataFrame([("a", 1), ("c", 5)], "k string, at bigint")
    assert sorted(tuple(r) for r in skew.walked(starts, jump, ["k"], "at").collect()) == [("a", i) for i in range(1, 203, 3)] + [("c", 5)]
    assert skew.walked(starts.limit(0), jump.limit(0), ["k"], "at").count() == 0


def test_map_results_of_a_hot_step(spark):
    rnd = random.Random(6)
    items = [("r", "hot" if i % 10 else "cold", i, rnd.random() < 0.6, "m") for i in range(500)] + [(None, "s", 3, False, None)]
    rnd.shuffle(items)
    got = {(r.run_id, r.step_id, r["index"]): (r.place, r.failure) for r in ag.map_results(spark.createDataFrame(items, "run_id string, step_id string, index bigint, ok boolean, message string"), rows_per_chunk=64).collect()}
    for run, step, i, ok, _ in items:
        before = [x for x in items if x[:2] == (run, step) and x[2] <= i]
        assert got[run, step, i] == (len(before), None if ok else sum(not x[3] for x in before))
