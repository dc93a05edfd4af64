"""Cases that no bench view holds: null keys, ties in time, bad values, disabled rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import filters as flt
from tidemark.operators import joins as jn
from tidemark.operators import ranking as rk
from tidemark.operators import skew
from tidemark.plans import alerts as al
from tidemark.plans import explain as ex
from tidemark.operators.skew import spaced_firsts
from tidemark.streaming import operators as so
from tidemark.streaming import runtime as rt
from tidemark.streaming import stateful as sf
from tests.conftest import ERR

T0 = dt.datetime(2026, 1, 1)


def at(**kw):
    return T0 + dt.timedelta(**kw)


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", 7)], "seq bigint, g string, v bigint")
    got = skew.chunked_lag(df, ["g"], "seq", {"v": "p"}, 1, index="i")
    assert {(r.seq, r.p, r.i) for r in got.collect()} == {(1, None, 1), (2, 5, 2), (3, None, 1)}
    got = skew.chunked_running_sum(df, ["g"], "seq", F.col("v"), "s", 1)
    assert {(r.seq, r.s) for r in got.collect()} == {(1, 5), (2, 11), (3, 7)}
    ask = spark.createDataFrame([(1, None)], "ask bigint, g string")
    hit = spark.createDataFrame([(4, None, "x")], "ms bigint, g string, name string")
    assert skew.first_at_or_after(ask, hit, ["g"], "ask", "ms", ["name"]).first().name == "x"


def test_first_resume_takes_one_event(spark):
    m = spark.createDataFrame([("t", "r", "s", T0, 5, at(days=2)), ("t", "r", "s", T0, 9, at(days=1)), ("t", "r", "z", T0, None, None)],
                              "tenant_id string, run_id string, step_id string, wait_ts timestamp, seq bigint, event_ts timestamp")
    got = {r.step_id: (r.seq, r.event_ts, r.outcome) for r in so.first_resume(m).collect()}
    assert got == {"s": (9, at(days=1), "resumed"), "z": (None, None, "WAIT_TIMEOUT")}


def test_star_is_a_correlation_like_any_other(spark):
    waits = spark.createDataFrame([("t", "r", "star", "e", "*", T0, at(hours=5)), ("t", "r", "any", "e", None, T0, at(hours=5))],
                                  "tenant_id string, run_id string, step_id string, wait_event string, wait_correlation string, ts timestamp, wake_at timestamp")
    events = spark.createDataFrame([("t", "e", "other", at(hours=1), 1), ("t", "e", "*", at(hours=2), 2)], "tenant_id string, type string, correlation string, ts timestamp, seq bigint")
    assert {r.step_id: r.seq for r in so.waits_with_timeout(waits, events).collect()} == {"star": 2, "any": 1}


def test_once_forgets_after_its_time(spark):
    rows = [("g", "k", at(days=0), 1), ("g", "k", at(days=3), 2), ("g", "k", at(days=74), 3), ("h", "k", at(days=1), 4)]
    fires = spark.createDataFrame(rows, "trigger_id string, fire_key string, ts timestamp, seq bigint")
    assert {r.seq for r in so.fire_once(fires).collect()} == {1, 3, 4}


def test_repeats_do_not_prolong_the_memory(spark, tmp_path):
    """Firings on days 0, 20, 40, 60 and 75: the record of day 0 is gone on day 40, that of day 40 on day 75."""
    rows = [("g", "k", at(days=d), s) for s, d in enumerate((0, 20, 40, 60, 75, 75))] + [(None, "k", at(days=1), 9), (None, "k", at(days=2), 10)]
    fires = spark.createDataFrame(rows, "trigger_id string, fire_key string, ts timestamp, seq bigint")
    assert {r.seq for r in so.fire_once(fires).collect()} == {0, 2, 4, 9}
    live = rt.run_available(so.fire_once(rt.replayed(fires, "ts", "fires", slices=3)), "once")
    assert live.columns == fires.columns and {r.seq for r in live.collect()} == {0, 2, 4, 9}


def test_spaced_firsts_of_a_long_chain(spark):
    rnd = random.Random(8)
    rows, want = [], set()
    for k in ("hot", None, "z"):
        t, last = 0, None
        for _ in range(700 if k == "hot" else 20):
            t += rnd.choice([0, 1, 3, 10, 60])
            rows.append((k, t))
            if last is None or t - last > 25:
                last = t
                want.add((k, t))
    got = spaced_firsts(spark.createDataFrame(rows, "k string, at bigint"), ["k"], "at", 25)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert spaced_firsts(spark.createDataFrame([], "k string, at bigint"), ["k"], "at", 25).count() == 0


def test_requests_without_a_key_are_accepted(spark):
    ddl = "seq bigint, tenant_id string, workflow_name string, dedup_key string, ms bigint, cancelled boolean"
    rows = [(1, "t", "w", None, 0, False), (2, "t", "w", None, 1, False), (3, "t", "w", "a", 2, True), (4, "t", "w", "a", 2, False), (5, "t", "w", "a", 2, False), (6, "t", "w", "a", 1003, False)]
    requests = spark.createDataFrame(rows, ddl)
    want = {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "deduplicated", 6: "accepted"}
    assert {r.seq: r.status for r in sf.dedup_requests(requests, 1000).collect()} == want
    timed = requests.withColumn("ts", F.timestamp_millis("ms"))
    live = sf.on_stream(rt.replayed(timed, "ts", "requests", slices=2), ["tenant_id", "workflow_name", "dedup_key"], ["ms", "seq"], lambda: sf.DedupWindow(1000), sf.DedupWindow.fields)
    assert {r.seq: r.status for r in rt.run_available(live, "dedup").collect()} == want


def test_first_failed_step_goes_by_completion(spark):
    steps = spark.createDataFrame(
        [("r", s, "failed", None, (s, "m", "transient", True), None, seq) for s, seq in (("s10", 4), ("s2", 3), ("s1", None))],
        f"run_id string, step_id string, status string, handled string, error {ERR}, compensation_status string, completed_seq bigint")
    assert ex.first_bad_step(steps).first().bad.step_id == "s2"
    assert ex.first_bad_step(steps.where("step_id <> 's2'").withColumn("completed_seq", F.lit(None).cast("bigint"))).first().bad.step_id == "s1"


def test_only_enabled_completion_triggers(spark):
    runs = spark.createDataFrame([("r", "t", "w", "succeeded")], "id string, tenant_id string, workflow_name string, status string")
    t = spark.createDataFrame([("a", "t", "w", "any", "completion", True), ("b", "t", "w", "any", "completion", False), ("c", "t", "w", "any", "event", True)],
                              "id string, tenant_id string, on_workflow string, want string, type string, enabled boolean")
    assert [r.trigger_id for r in jn.completions_to_triggers(runs, t).collect()] == ["a"]


def test_bad_values_reject_the_row(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "v string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    assert [r.v for r in flt.where_passes(df, "v > 5").collect()] == ["7"]
    got = {r.v: r.bad for r in flt.with_first_violation(df, {"big": "cast(v as int) > 5", "part": "10 / (cast(v as int) - 7) > 0"}, "bad").collect()}
    assert got == {"7": "part", "x": "big", None: "big"}
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_every_queued_run_has_a_place(spark):
    rows = [(f"r{i:03}", "t", "w", "queued", i % 3, at(minutes=7 * (i % 50))) for i in range(200)]
    runs = spark.createDataFrame(rows, "id string, tenant_id string, workflow_name string, status string, priority int, created_at timestamp")
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[4], r[5], r[0])))}
    assert {r.id: r.position for r in rk.queue_positions(runs).collect()} == want
    assert rk.queue_positions(runs, 10).count() == 10


def test_alert_history_limit_is_per_tenant(spark):
    rows = [(t, i, "alert.raised", T0, '{"key":"k"}') for t in "ab" for i in range(5)]
    e = spark.createDataFrame(rows, "tenant_id string, seq bigint, type string, ts timestamp, data string")
    assert al.alert_history(e).count() == 10
    assert {(r.tenant_id, r.seq) for r in al.alert_history(e, limit=2).collect()} == {(t, i) for t in "ab" for i in (3, 4)}


def test_explanations_come_from_the_records(spark):
    err = "struct<code:string,message:string,class:string,retryable:boolean>"
    runs = spark.createDataFrame([
        ("a", "failed", None, T0, T0), ("b", "succeeded", None, T0, T0 + dt.timedelta(seconds=3)), ("c", "rolled-back", ("X", "odd {at}", "business", False), T0, T0),
        ("d", "waiting-event", None, T0, None), ("e", "compensation-failed", None, T0, T0), ("f", "strange", None, None, None), ("g", None, None, None, None)],
        f"id string, status string, error {err}, started_at timestamp, finished_at timestamp").withColumn("tenant_id", F.lit("t"))
    step = lambda run, name, status, error=None, undo=None, seq=None: (run, name, status, None, error, undo, seq)
    steps = spark.createDataFrame([
        step("a", "pay {step}", "failed", ("HTTP_500", "no answer", "transient", True)), step("c", "s1", "succeeded", undo="done"), step("d", "hold", "waiting-event"),
        step("e", "s1", "succeeded", undo="failed"), step("e", "s2", "failed", ("E", None, None, None), seq=2)],
        f"run_id string, step_id string, status string, handled string, error {err}, compensation_status string, completed_seq bigint")
    got = {r.id: r for r in ex.explain_runs(runs, steps).collect()}
    assert got["a"].headline == "Failed at “pay {step}”." and got["a"].cause == "HTTP_500 (transient): no answer"
    assert got["a"].suggestion == "HTTP_500 is marked retryable: run it again" and got["a"].what_happened_next == "0 steps undone, 0 not"
    assert got["b"].headline.startswith("Succeeded in 3")
    assert got["b"].cause is None and got["b"].suggestion is None
    assert got["c"].headline == "Failed at “a step” and was rolled back." and got["c"].cause == "X (business): odd {at}" and got["c"].what_happened_next == "1 steps undone, 0 not"
    assert got["d"].headline == "Paused, waiting for an event at “hold”."
    assert got["e"].suggestion.endswith("first clear up after 1 steps") and got["e"].cause == "E (unknown)"
    assert got["f"].headline == "Failed at “a step”." == got["g"].headline
