"""The queries over all rules and all alert sources: equal to their SQL twins, and more than a part of them gives."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.plans import findings as fd
from tidemark.plans import alerts as al
from tools.oracle import compare, connect
from workload import alerts, findings
from workload.views import History, ts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no bench data here")

SIX = ("ignored-failure", "failing-step", "retry-storm", "shell-sunset", "schedule-drift", "queue-starvation")


def rows(spark, name):
    df = entry.queries()[name](spark, SF)
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


@pytest.mark.parametrize("name", ["r16_analyse", "r17_reconcile", "k08_severity_order", "l10_evaluate_all", "a26_live_gauges", "a24_map_results", "j08_triggers_with_conditions"])
def test_all_rules_equal_their_twins(spark, name):
    ok, text = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_all_rules_contain_the_six(spark, monkeypatch):
    ran = set()
    for k, rule in list(fd.RULES.items()):
        monkeypatch.setitem(fd.RULES, k, lambda f, t, k=k, rule=rule: ran.add(k) or rule(f, t))
    got = rows(spark, "r16_analyse")
    assert ran == set(fd.RULES) and len(ran) == 15
    six = {k: fd.RULES[k] for k in SIX}
    part = findings.show(fd.analyse(findings.facts(History(spark, SF)), findings.LOOSE, six))
    part = {tuple(r) for r in part.select(*sorted(part.columns)).collect()}
    assert part and part < got and rows(spark, "r18_analyse_all_rules") == got


def test_alerts_of_all_sources(spark):
    h = History(spark, SF)
    h.chained_events = h.chained_events.withColumn("prev_hash", F.when(F.col("seq") % 500 == 7, "x").otherwise(F.col("prev_hash")))  # breaks the chain
    got = {(r.tenant_id, r.key) for r in alerts.l11(h).collect()}
    part = {(r.tenant_id, r.key) for r in al.evaluate(h.runs, h.live_steps, h.approvals, ts(alerts.AT), alerts.CFG).collect()}
    broken = {(r.tenant_id, r.key) for r in alerts.l06(h).collect()}
    open_ = {(r.tenant_id, r.key) for r in alerts.l05(h).collect()}
    assert broken and got == part | broken | open_
    gauges = {(r.metric, r.labels) for r in alerts.a28(h).collect()}
    assert ("circuit_open", 'capability="cap-3"') in gauges and len(gauges) == 16
