import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import bad, ok
from tidemark.operators import ranking as rk
from tidemark.plans import alerts as al
from tidemark.plans import overview as ov


def as_of(hist):
    return F.expr(f"timestamp'{hist.now}'")


def keys(df):
    return {(r.key, r.severity) for r in df.collect()}


def test_alert_cycle(spark, hist):
    for i in range(6):
        hist.run("pay", {"a": ok() if i < 2 else bad()}, status="succeeded" if i < 2 else "failed")
    t = hist.frames(spark)
    now = as_of(hist)
    found = al.evaluate(t["runs"], t["steps"], t["approvals"], now)
    assert keys(found) == {("workflow-failing:pay", "warning")}
    assert "4 of 6 runs failed in the last 30.0min (67%). Latest error: BOOM — boom" in found.first().message
    none = spark.createDataFrame([], "tenant_id string, key string, severity string, title string, message string, raised_at timestamp, last_notified_at timestamp")
    first = al.transitions(found, none, now)
    assert [r.event for r in first.collect()] == ["raised"]
    opened = first.drop("event", "open_for_ms")
    assert [r.event for r in al.transitions(found, opened, now + F.expr("interval 5 minutes")).collect()] == ["open"]
    assert [r.event for r in al.transitions(found, opened, now + F.expr("interval 6 hours")).collect()] == ["reminder"]
    later = now + F.expr("interval 40 minutes")
    quiet = al.evaluate(t["runs"], t["steps"], t["approvals"], later)
    (done,) = al.transitions(quiet, opened, later).collect()
    assert (done.event, done.open_for_ms) == ("resolved", 2_400_000)


def test_integrity_alert_needs_a_check_to_resolve(spark):
    now = F.expr("timestamp'2026-06-01'")
    opened = spark.createDataFrame([("t", "audit-integrity", "critical", "x", "y", dt.datetime(2026, 5, 31), dt.datetime(2026, 5, 31))],
                                   "tenant_id string, key string, severity string, title string, message string, raised_at timestamp, last_notified_at timestamp")
    none = opened.select("tenant_id", "key", "severity", "title", "message").limit(0)
    assert al.transitions(none, opened, now, audit_checked=False).first().event == "open"
    assert al.transitions(none, opened, now).first().event == "resolved"


def test_dashboard(spark, hist):
    for _ in range(8):
        hist.run("w", {"a": ok()}, cost=1.0)
    for _ in range(2):
        hist.run("w", {"a": bad()}, status="failed", cost=4.0)
    hist.run("w", {}, status="cancelled")
    hist.run("w", {}, status="queued")
    rid = hist.run("w", {"a": ok()}, status="running")
    hist.approve(rid, "w", "gate", "pending", minutes=0)
    hist.run("w", {"a": bad()}, status="failed", dry=True, cost=99.0)
    t = hist.frames(spark)
    r = ov.totals(t["runs"], t["approvals"], as_of(hist)).first()
    assert (r.total, r.succeeded, r.failed, r.cancelled, r.active, r.queued) == (13, 8, 2, 1, 1, 1)
    assert (r.success_rate, r.manual_intervention_rate, r.cost, r.approvals_pending) == (0.8, 1 / 13, 16.0, 1)
    assert (r.p50_ms, r.p95_ms, r.median_decision_ms) == (1000, 1000, None)
    hours = ov.hourly(t["runs"], t["runs"], as_of(hist), 24)
    assert hours.count() == 24
    assert ov.failing_steps(t["runs"], t["steps"], as_of(hist)).first().top_error == "HTTP_500"


def test_empty_history(spark, hist):
    t = hist.frames(spark)
    assert al.evaluate(t["runs"], t["steps"], t["approvals"], F.expr("timestamp'2026-06-01'")).count() == 0
    assert ov.totals(t["runs"], t["approvals"], F.expr("timestamp'2026-06-01'")).count() == 0


def test_canary_filters_after_the_newest_hundred(spark, hist):
    for i in range(10):
        hist.run("w", {}, status="failed", canary=True)
    for i in range(95):
        hist.run("w", {})
    t = hist.frames(spark)
    s = spark.createDataFrame([("default", "w", "2.0.0", 10)], "tenant_id string, name string, canary_version string, canary_percent int")
    r = rk.canary_verdicts(t["runs"], s).first()
    assert (r.runs, r.failed, r.roll_back) == (5, 5, True)


def test_alert_text(spark):
    df = spark.range(1).select(al.alert_text(F.lit("critical"), F.lit("raised"), F.lit("T"), F.lit("M"), F.lit("t1")).alias("a"), al.alert_text(F.lit("warning"), F.lit("resolved"), F.lit("T"), F.lit("M"), F.lit("t1")).alias("b"))
    assert df.first() == ("[CRITICAL] T\nM\n(tenant t1)", "[RESOLVED] T\n(tenant t1)")
