import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.session import ROCKSDB
from tidemark.sources.external import once_writer
from tidemark.streaming import operators as so
from tidemark.streaming import runtime as rt
from tidemark.streaming import stateful as sf

T0 = dt.datetime(2026, 1, 1)


def files(spark, path, *batches, ddl):
    """A file stream source that delivers each batch as its own file, oldest first."""
    import os
    import time

    for i, rows in enumerate(batches):
        d = f"{path}/b{i}"
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(d)
        for name in os.listdir(d):
            if name.endswith(".parquet"):
                os.utime(f"{d}/{name}", (time.time() - 1000 + i * 10,) * 2)
    schema = spark.createDataFrame([], ddl).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


OPS = "seq bigint, ms bigint, capability string, op string"


def operations(n=600):
    rnd = random.Random(11)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([100, 2000, 40_000])
        rows.append((i + 1, t, rnd.choice(["a", "b"]), rnd.choices(["check", "failure", "success", "release"], [5, 6, 1, 1])[0]))
    return rows


def expected_circuits(rows):
    rules, out = {}, {}
    for seq, ms, cap, op in rows:
        out[seq] = rules.setdefault(cap, sf.Circuit()).step(type("R", (), {"ms": ms, "op": op}))
    return out


def test_circuit_rule():
    c = sf.Circuit()
    step = lambda ms, op: c.step(type("R", (), {"ms": ms, "op": op}))
    for i in range(4):
        assert step(i, "failure")[0] == "closed"
    assert step(4, "failure")[0] == "open"
    assert step(10_004, "check")[2:] == (False, 20_000)
    assert step(30_004, "check")[:3] == ("half-open", 5, True)
    assert step(30_005, "check")[2:] == (False, 1000)
    assert step(30_006, "failure")[0] == "open"
    assert step(60_006, "check")[2] is True and step(60_007, "success")[:2] == ("closed", 0)


def test_circuits_over_history_and_stream(spark, tmp_path):
    rows = operations()
    want = expected_circuits(rows)
    shape = lambda df: {r.seq: (r.state, r.failures, r.allowed, None if r.retry_after_ms is None else int(r.retry_after_ms)) for r in df.collect()}
    # after a success the failure count restarts, so only rows between successes may differ in memory of earlier ones
    assert shape(sf.replay_circuits(spark.createDataFrame(rows, OPS), rows_per_chunk=64)) == want
    src = files(spark, str(tmp_path / "ops"), rows[:200], rows[200:350], rows[350:], ddl=OPS)
    got = rt.run_available(sf.on_stream(src, ["capability"], ["seq"], sf.Circuit, sf.Circuit.fields), "circuits")
    assert shape(got) == want


@pytest.mark.parametrize("threshold,cooldown", [(3, 5000), (1, 0), (5, 1)])
def test_circuit_without_success_over_history(spark, threshold, cooldown):
    # a capability that hardly ever succeeds, one that often does, one without a name, unknown operations, equal times
    rnd, ms, rows = random.Random(3), 0, []
    for seq in range(1500):
        ms += rnd.choice([0, 0, 1, 50, 900])
        cap = rnd.choice(["hot", "hot", "hot", "b", None])
        rows.append((seq, ms, cap, rnd.choice(["failure"] * 4 + ["check"] * 6 + ["release", None]) if cap == "hot" else rnd.choice(["success", "failure", "failure", "check", "release"])))
    rules, want = {}, {}
    for seq, at, cap, op in rows:
        want[seq] = rules.setdefault(cap, sf.Circuit(threshold, cooldown)).step(type("R", (), {"ms": at, "op": op}))
    got = sf.replay_circuits(spark.createDataFrame(rows, OPS), threshold, cooldown, rows_per_chunk=200)
    assert {r.seq: (r.state, r.failures, r.allowed, r.retry_after_ms) for r in got.collect()} == want


REQ = "seq bigint, tenant_id string, workflow_name string, dedup_key string, ms bigint, cancelled boolean"


def test_dedup_window_is_greedy(spark):
    rnd = random.Random(4)
    t, rows = 0, []
    for i in range(500):
        t += rnd.choice([1, 50, 400, 1500])
        rows.append((i + 1, "t", "w", rnd.choice("xxy"), t, rnd.random() < 0.2))
    got = {r.seq: (r.status, r.joined) for r in sf.dedup_requests(spark.createDataFrame(rows, REQ), 1000, rows_per_chunk=40).collect()}
    open_ = {}
    for seq, _, _, key, ms, cancelled in rows:
        at, owner = open_.get(key, (None, None))
        if at is not None and ms - at <= 1000:
            assert got[seq] == ("deduplicated", owner)
        else:
            assert got[seq] == ("accepted", seq)
            if not cancelled:
                open_[key] = (ms, seq)


def test_ledger():
    rule = sf.Ledger(lease_ms=100, ttl_ms=1000)
    step = lambda ms, op, owner, out=None: rule.step(type("R", (), {"ms": ms, "op": op, "owner": owner, "output": out}))
    assert step(0, "claim", "a") == ("claimed", False, None)
    assert step(50, "claim", "b")[0] == "busy"
    assert step(60, "claim", "a") == ("claimed", True, None)
    assert step(70, "complete", "b")[0] == "ignored"
    assert step(80, "complete", "a", "done")[0] == "completed"
    assert step(90, "claim", "b") == ("replay", None, "done")
    assert step(95, "release", "a")[0] == "ignored"
    assert step(1080, "claim", "b") == ("claimed", True, None)
    assert step(1090, "release", "b")[0] == "released"
    assert step(1095, "claim", "c") == ("claimed", False, None)


def test_metrics_stream_equals_batch(spark, tmp_path):
    ddl = "ts timestamp, type string, data string, run_id string"
    rows = []
    kinds = ["run.succeeded", "run.failed", "step.succeeded", "step.failed", "step.retry-scheduled", "policy.decision", "trigger.fired", "other"]
    for i in range(200):
        data = '{"durationMs":%d,"replayed":%s,"willRetry":%s,"error":{"class":"business"},"action":"run","effect":"deny"}' % (i * 37, "true" if i % 3 == 0 else "false", "true" if i % 2 else "false")
        rows.append((T0 + dt.timedelta(seconds=i), kinds[i % len(kinds)], data, "r"))
    src = files(spark, str(tmp_path / "m"), rows[:90], rows[90:], ddl=ddl)
    out = rt.newest_per_key(rt.run_available(so.metrics(src), "m", mode="update"), ["metric", "labels"])
    want = so.metrics(spark.createDataFrame(rows, ddl))
    exact = lambda df: sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect())
    assert exact(out) == exact(want)
    labels = {(r["metric"], r["labels"]): r["count"] for r in want.collect()}
    assert labels[("steps_total", 'outcome="replayed"')] + labels[("steps_total", 'outcome="succeeded"')] == 25
    assert labels[("policy_denials_total", 'action="run",effect="deny"')] == 25


def test_fire_once_across_batches(spark, tmp_path):
    ddl = "trigger_id string, fire_key string, ts timestamp"
    row = lambda k, m: ("t", k, T0 + dt.timedelta(minutes=m))
    src = files(spark, str(tmp_path / "f"), [row("a", 0), row("b", 1), row("a", 2)], [row("a", 3), row("c", 4)], ddl=ddl)
    assert sorted(r.fire_key for r in rt.run_available(so.fire_once(src), "f").collect()) == ["a", "b", "c"]


def test_wait_times_out_on_the_stream(spark, tmp_path):
    w = "tenant_id string, run_id string, step_id string, wait_event string, wait_correlation string, ts timestamp, wake_at timestamp"
    e = "tenant_id string, type string, correlation string, ts timestamp, seq bigint"
    at = lambda h: T0 + dt.timedelta(hours=h)
    waits = [("t", "r1", "s", "paid", "A", at(0), at(5)), ("t", "r2", "s", "paid", "B", at(0), at(5)), ("t", "r3", "s", "paid", None, at(2), at(5)), ("t", "last", "s", "paid", "Q", at(2000), at(2001))]
    events = [("t", "paid", "A", at(1), 1), ("t", "paid", "A", at(3), 2), ("t", "paid", "B", at(6), 3), ("t", "none", None, at(2000), 4)]
    batch = so.waits_with_timeout(spark.createDataFrame(waits, w), spark.createDataFrame(events, e))
    assert {r.run_id: (r.outcome, r.seq) for r in batch.collect()} == {"r1": ("resumed", 1), "r2": ("WAIT_TIMEOUT", None), "r3": ("resumed", 2), "last": ("WAIT_TIMEOUT", None)}
    rows = so.offers(spark.createDataFrame(waits, w), spark.createDataFrame(events, e))
    got = rt.run_available(so.waits_stream(rt.replayed(rows, "ts", "offers", slices=3)), "w")
    got = {r.run_id: (r.outcome, r.seq) for r in got.collect()}
    assert got == {"r1": ("resumed", 1), "r2": ("WAIT_TIMEOUT", None), "r3": ("resumed", 2)}  # the last one is still open


def test_waits_on_the_stream_equal_history(spark, tmp_path):
    """Shuffled rows within the lateness, several micro-batches and a restart give the rows of the batch form."""
    rnd = random.Random(6)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    waits = [("t", f"r{i}", "s", rnd.choice(["paid", "sent"]), rnd.choice(["A", "B", None]), at(s := rnd.randrange(36_000)), at(s + rnd.choice([0, 60, 4000]))) for i in range(150)]
    events = [("t", rnd.choice(["paid", "sent"]), rnd.choice(["A", "B", "C", None]), at(rnd.randrange(40_000)), i) for i in range(200)]
    w = spark.createDataFrame(waits, "tenant_id string, run_id string, step_id string, wait_event string, wait_correlation string, ts timestamp, wake_at timestamp")
    e = spark.createDataFrame(events, "tenant_id string, type string, correlation string, ts timestamp, seq bigint")
    want = sorted(map(tuple, so.waits_with_timeout(w, e).collect()))
    offered = so.offers(w, e)
    rows = sorted((tuple(r) for r in offered.collect()), key=lambda r: (r[4], rnd.random()))
    near = sorted(rows, key=lambda r: r[4] + dt.timedelta(seconds=rnd.randrange(3000)))  # up to 50 minutes out of order
    ddl = "tenant_id string, wait_event string, any boolean, corr string, ts timestamp, kind int, wake_us bigint, seq bigint, run_id string, step_id string"
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    end = [("", "", True, "", at(90_000), 1, None, 0, None, None)]
    third = len(near) // 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for i, part in enumerate((near[:third], near[third : 2 * third], near[2 * third :], end)):
            spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
            if i in (1, 3):  # stopped after two files, then started again
                src = spark.readStream.schema(offered.schema).option("maxFilesPerTrigger", 1).parquet(path)
                q = so.waits_stream(src, "1 hour").writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
                q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select("tenant_id", "run_id", "step_id", "wait_ts", "seq", "event_ts", "outcome").collect()), key=str) == sorted(want, key=str)


def test_approval_timers(spark, tmp_path):
    ddl = "id string, tenant_id string, ts timestamp, seq bigint, status string, on_timeout string, escalated boolean, requested_ms bigint, expires_ms bigint"
    ms = lambda m: int((T0 + dt.timedelta(minutes=m)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    row = lambda i, m, seq, status="pending", rule="deny": (i, "t", T0 + dt.timedelta(minutes=m), seq, status, rule, False, ms(0), ms(60))
    first = [row("deny", 0, 1), row("auto", 0, 2, rule="approve"), row("esc", 0, 3, rule="escalate"), row("done", 0, 4)]
    second = [row("done", 30, 5, status="approved")]
    src = files(spark, str(tmp_path / "a"), first, second, [row("tick", 90, 6)], [row("tick", 200, 7)], [row("tick", 400, 8)], ddl=ddl)
    got = rt.run_available(sf.approval_timers(src), "approvals")
    actions = {}
    for r in got.orderBy("at_ms").collect():
        actions.setdefault(r.id, []).append(r.action)
    actions.pop("tick", None)
    assert actions == {"deny": ["time-out"], "auto": ["approve"], "esc": ["escalate", "time-out"]}


def test_writes_happen_once(spark, tmp_path):
    ddl = "idempotency_key string, seq bigint, value string"
    table, keys = str(tmp_path / "table"), str(tmp_path / "keys")
    write = once_writer(table, keys)
    a = spark.createDataFrame([("k1", 1, "x"), ("k1", 2, "y"), ("k2", 3, "z")], ddl)
    b = spark.createDataFrame([("k2", 4, "again"), ("k3", 5, "w")], ddl)
    write(a, 0)
    write(b, 1)
    write(b, 1)  # the batch is retried
    assert sorted((r.idempotency_key, r.value) for r in spark.read.parquet(table).collect()) == [("k1", "x"), ("k2", "z"), ("k3", "w")]


@pytest.mark.parametrize("after, want", [(None, 4), (2, 2)])
def test_fan_out(spark, after, want):
    e = spark.createDataFrame([("t", i, "run.failed", T0) for i in (1, 2, 3, 3)] + [("t", 4, "run.started", T0)], "tenant_id string, seq int, type string, ts timestamp")
    h = spark.createDataFrame([("h1", "t", ["run.failed"]), ("h2", "u", ["run.failed"]), ("h3", "t", ["run.started", "run.started"])], "hook_id string, tenant_id string, events array<string>")
    assert so.fan_out(e, h, after).count() == want


def test_alert_lifecycle_over_batches(spark, tmp_path):
    path = str(tmp_path / "alerts")
    ddl = "tenant_id string, key string, severity string, title string, message string"
    plan = {0: (["a", "b"], 0), 1: (["a"], 10), 2: (["a"], 370), 3: ([], 400)}

    def evaluate(batch):
        keys, minutes = plan[batch.first().n]
        return spark.createDataFrame([("t", k, "warning", k, "m") for k in keys], ddl), F.lit(T0 + dt.timedelta(minutes=minutes)), True

    step = so.alert_lifecycle(evaluate, path)
    for i in (0, 1, 1, 2, 3):  # batch 1 is retried
        step(spark.createDataFrame([(i,)], "n int"), i)
    got = {(r.batch, r.key, r.event) for r in spark.read.parquet(path).collect()}
    assert got == {(0, "a", "raised"), (0, "b", "raised"), (1, "a", "open"), (1, "b", "resolved"), (2, "a", "reminder"), (3, "a", "resolved")}


def test_canary_watch(spark, tmp_path):
    """Verdicts after each micro-batch are those of the whole history so far; only the newest runs are kept."""
    from tidemark.operators import ranking as rk

    ddl = "tenant_id string, workflow_name string, id string, status string, canary boolean, workflow_version string, created_at timestamp"
    rnd = random.Random(5)
    row = lambda i, status: ("t", rnd.choice("vw"), f"r{i:03d}", status, rnd.random() < 0.8, rnd.choice(["2.0.0", "2.0.0", "1.0.0"]), T0 + dt.timedelta(minutes=i))
    batches = [[row(i, rnd.choice(["succeeded", "failed", "running", "cancelled"])) for i in range(n * 20, n * 20 + 20)] for n in range(4)]
    batches[2].append((*[x for x in batches[0] if x[3] == "running"][0][:3], "failed", True, "2.0.0", T0))  # an old run ends late
    settings = spark.createDataFrame([("t", "w", "2.0.0", 10), ("t", "v", "2.0.0", 10), ("t", "u", "2.0.0", 10)], "tenant_id string, name string, canary_version string, canary_percent int")
    trials = rt.run_available(so.canary_trials(files(spark, str(tmp_path / "runs"), *batches, ddl=ddl), newest=15), "trials", mode="update")
    for n in range(4):
        got = so.trial_verdicts(rt.newest_per_key(trials.where(F.col("batch") <= n), ["tenant_id", "workflow_name"]), settings, min_runs=3)
        last = {r[2]: r for b in batches[: n + 1] for r in b}
        want = rk.canary_verdicts(spark.createDataFrame(list(last.values()), ddl), settings, newest=15, min_runs=3)
        cols = ["workflow_name", "canary_version", "runs", "failed", "roll_back"]
        assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect()), n
    so.canary_watch(settings, str(tmp_path / "v"), min_runs=3)(trials.where("batch = 3").drop("batch"), 3)
    assert spark.read.parquet(str(tmp_path / "v")).count() == len(trials.where("batch = 3").select("workflow_name").collect())


class _Tally:
    """Counts rows; a later release says a hundred times as much."""

    fields = "n int"
    memory = "count int"

    def __init__(self):
        self.count = 0

    def step(self, row):
        self.count += 1
        return (self.count,)


class _TallyToo(_Tally):
    fields = "n int"

    def step(self, row):
        super().step(row)
        return (self.count * 100,)


def test_state_has_typed_columns_and_outlives_the_code(spark, tmp_path):
    ddl = "key string, seq bigint"
    path, state, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows, make in (([("a", 1), ("a", 2), ("b", 3)], _Tally), ([("a", 4)], _TallyToo)):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
            src = spark.readStream.schema(ddl).parquet(path)
            q = sf.on_stream(src, ["key"], ["seq"], make, "n int").writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
            q.awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "rule").load(state)
        assert {(r["key"]["key"], r["value"]["count"]) for r in held.collect()} == {("a", 3), ("b", 1)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {(r.seq, r.n) for r in spark.read.parquet(out).collect()} == {(1, 1), (2, 2), (3, 1), (4, 300)}


def test_follow_ends_with_the_run(spark, tmp_path):
    ddl = "seq bigint, tenant_id string, run_id string, type string, ts timestamp"
    row = lambda i, t: (i, "t", "r", t, T0 + dt.timedelta(seconds=i))
    src = files(spark, str(tmp_path / "src"), [row(1, "run.started"), row(2, "step.started")], [row(3, "run.succeeded")], ddl=ddl)
    so.follow(so.tail(src, "r", "t", after_seq=1), str(tmp_path / "out"), str(tmp_path / "cp"), timeout=60)
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]
