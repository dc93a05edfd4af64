"""Plan graphs: both ways of walking them give the same, on chains of any length and on cycles."""

import random

import pytest

from tidemark.plans import definitions as df_

EDGE = "tenant_id string, plan_hash string, step_id string, depends_on string"


@pytest.fixture(scope="module")
def graphs(spark):
    rnd = random.Random(3)
    edges = [("t", "chain", f"s{i + 1}", f"s{i}") for i in range(26)]
    edges += [("t", "ring", f"s{(i + 1) % 5}", f"s{i}") for i in range(5)] + [("t", "ring", "tail", "s0")]
    edges += [("t", "mesh", f"s{b}", f"s{a}") for a, b in {tuple(sorted(rnd.sample(range(15), 2))) for _ in range(30)}]
    steps = sorted({(t, p, x) for t, p, *xs in edges for x in xs} | {("t", "mesh", "alone")})
    rows = [(*s, rnd.choice([None, "public", "internal", "confidential"]) if s[1] != "chain" or s[2] != "s0" else "secret") for s in steps]
    return edges, rows, spark.createDataFrame(edges, EDGE), spark.createDataFrame(rows, "tenant_id string, plan_hash string, step_id string, sensitivity string")


def test_sensitivity_on_any_size(graphs, monkeypatch):
    edges, rows, e, s = graphs
    order = {None: 1, "public": 0, "internal": 1, "confidential": 2, "secret": 3}
    want = {(p, x): order[v] for _, p, x, v in rows}
    for _ in range(40):
        for _, p, x, y in edges:
            want[p, x] = max(want[p, x], want[p, y])
    got = []
    for limit in (10_000, 3):  # all plans in a row each, all plans level by level
        monkeypatch.setattr(df_, "ROW_EDGES", limit)
        got.append({(r.plan_hash, r.step_id): order[r.sensitivity] for r in df_.propagate_sensitivity(s, e).collect()})
    assert got[0] == want and got[1] == want


def test_depths_on_any_size(graphs, monkeypatch):
    _, _, e, s = graphs
    got = []
    for limit in (10_000, 3):
        monkeypatch.setattr(df_, "ROW_EDGES", limit)
        got.append({r.plan_hash: r.depth for r in df_.longest_chains(s, e).collect()})
    assert got[0] == got[1] and got[0]["chain"] == 27 and "ring" not in got[0]
