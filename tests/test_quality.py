import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.canonical import canonical
from tidemark.operators import quality as ql
from tidemark.plans import definitions as df_
from tidemark.sources import exports as ex
from tidemark.sources import external as xt
from tidemark.streaming import stateful as sf


def chain(n=12, tenants=("a", "b")):
    """Events as an appender would write them, with real content hashes."""
    rows, last = [], {}
    for seq in range(1, n + 1):
        t = tenants[seq % len(tenants)]
        ts = dt.datetime(2026, 1, 1, 0, 0, seq, 5000)
        data = {"z": seq, "a": 'x"ü\n'}
        prev = last.get(t, model.GENESIS_HASH)
        actor = None if seq % 3 else ("user", f"u{seq}", None)
        body = {"prev": prev, "id": f"evt_{seq}", "tenant": t, "ts": ts.strftime("%Y-%m-%dT%H:%M:%S.005Z"), "type": "run.started", "runId": "r1", "stepId": None, "attempt": 2 if seq % 2 else None,
                "actor": None if actor is None else {"type": "user", "id": f"u{seq}"}, "correlationId": None, "data": data}
        h = "sha256:" + hashlib.sha256(canonical(body).encode()).hexdigest()
        last[t] = h
        rows.append([seq, f"evt_{seq}", t, ts, "run.started", "r1", None, body["attempt"], actor, None, json.dumps(data), prev, h])
    return rows


def verify(spark, rows, chunk=4):
    df = spark.createDataFrame([tuple(r) for r in rows], model.schema_of("events"))
    return {r.tenant_id: (r.ok, r.checked, r.broken_at_seq, r.reason) for r in ql.verify_chain(df, rows_per_chunk=chunk).collect()}


LINK, CONTENT = "chain link does not match the previous event", "event content does not match its hash"


def test_chain_intact_tampered_and_shortened(spark):
    assert verify(spark, chain()) == {"a": (True, 6, None, None), "b": (True, 6, None, None)}
    rows = chain()
    rows[5][10] = '{"z":99}'  # seq 6, tenant a
    assert verify(spark, rows) == {"a": (False, 2, 6, CONTENT), "b": (True, 6, None, None)}
    rows = [r for r in chain() if r[0] != 5]  # tenant b loses its third event
    assert verify(spark, rows) == {"a": (True, 6, None, None), "b": (False, 2, 7, LINK)}


def test_chain_resumed_from_its_verified_head(spark):
    def frame(rows):
        return spark.createDataFrame([tuple(r) for r in rows], model.schema_of("events"))

    tampered = chain()
    tampered[8][10] = '{"z":99}'  # seq 9, tenant b
    gone = [r for r in chain() if r[0] != 8]  # tenant a loses its fourth event
    new_tenant = chain() + [[20 + i, *r[1:2], "c", *r[3:]] for i, r in enumerate(chain(2, ("c",)))]
    empty = spark.createDataFrame([], ql.HEADS)
    for rows, cut in ((tampered, 6), (tampered, 10), (gone, 7), (new_tenant, 12)):
        df = frame(rows)
        early = ql.verify_further(df.where(F.col("seq") <= cut), empty, rows_per_chunk=4)
        late = ql.verify_further(df, ql.verified_heads(early), rows_per_chunk=4)
        assert sorted(late.drop("head_seq", "head_hash").collect()) == sorted(ql.verify_chain(df, rows_per_chunk=3).collect())
    done = ql.verify_further(frame(chain()), None)
    assert {r.tenant_id: r.head_seq for r in done.collect()} == {"a": 12, "b": 11}
    again = ql.verify_further(frame(chain()), ql.verified_heads(done))  # nothing new
    assert sorted(again.collect()) == sorted(done.collect())


def test_event_checks(spark):
    e = spark.createDataFrame([("step.started", "r", '{"attempt":1}'), ("step.started", None, '{"attempt":1}'), ("step.started", "r", "{}"), ("nope", "r", "{}"), ("alert.raised", None, '{"key":1,"title":2}')], "type string, run_id string, data string")
    assert [(r.code, r.field) for r in ql.validate_events(e).orderBy(F.monotonically_increasing_id()).collect()] == [
        (None, None), ("MISSING_RUN_ID", "runId"), ("MISSING_EVENT_FIELD", "data.attempt"), ("UNKNOWN_EVENT_TYPE", "type"), ("MISSING_EVENT_FIELD", "data.severity")]
    assert len(model.EVENT_CATALOGUE) == 73


def test_oversized_payloads_keep_required_keys(spark):
    big = json.dumps({"attempt": 1, "durationMs": 5, "blob": "x" * 300, "more": [1]})
    e = spark.createDataFrame([("step.succeeded", big), ("step.succeeded", '{"attempt":1}'), ("run.started", big)], "type string, data string")
    a, b, c = [json.loads(r.data) for r in ql.truncate_payloads(e, 256).collect()]
    assert a == {"attempt": 1, "durationMs": 5, "_truncated": True, "_droppedKeys": a["_droppedKeys"], "_note": ql.NOTE}
    assert sorted(a["_droppedKeys"]) == ["blob", "more"] and b == {"attempt": 1}
    assert sorted(c["_droppedKeys"]) == ["attempt", "blob", "durationMs", "more"]


def test_json_against_a_schema(spark):
    spec = {
        "name": ql.Field("string", required=True, pattern="^[a-z]+$", max_length=5),
        "n": ql.Field("number", minimum=1),
        "tags": ql.Field("array", min_items=1, max_items=2),
        "mode": ql.Field("string", enum=("x", "y"), default='"x"'),
        "sub": ql.Field("object", fields={"k": ql.Field("integer", required=True)}),
    }
    rows = ['{"name":"abc","n":2,"tags":["a"],"sub":{"k":1}}', '{"name":"ABC","n":0,"tags":[],"mode":"z","sub":{"k":1.5,"q":1},"zz":1}', '{"n":"5"}', "[1]", "{}", "{bad"]
    got = [(sorted((i.path, i.code) for i in r.issues), r.filled) for r in ql.validate_json(spark.createDataFrame([(r,) for r in rows], "j string"), "j", spec).collect()]
    assert got[0][0] == [] and json.loads(got[0][1])["mode"] == "x"
    assert got[1][0] == [("$", "additionalProperties"), ("mode", "enum"), ("n", "minimum"), ("name", "pattern"), ("sub", "additionalProperties"), ("sub.k", "type"), ("tags", "minItems")]
    assert got[2][0] == [("n", "type"), ("name", "required")]
    assert got[3][0] == [("$", "type")] == got[5][0]
    assert json.loads(got[4][1]) == {"mode": "x"}


def test_readiness(spark):
    ddl = "run_id string, plan_hash string, step_id string, status string, handled string"
    def verdict(deps, mode="all", route=None):
        steps = [("r", "p", f"d{i}", s, h) for i, (s, h) in enumerate(deps)] + [("r", "p", "x", "pending", None)]
        edges = spark.createDataFrame([("t", "p", "x", f"d{i}") for i in range(len(deps))] + [("t", "p", "d0", "ghost")], "tenant_id string, plan_hash string, step_id string, depends_on string")
        modes = spark.createDataFrame([("p", "x", mode)], "plan_hash string, step_id string, mode string")
        routes = spark.createDataFrame([("p", "d0", route)], "plan_hash string, depends_on string, route_to string")
        out = ql.step_readiness(spark.createDataFrame(steps, ddl), edges, modes, routes)
        return {r.step_id: r.verdict for r in out.collect()}["x"]

    ok, no, skip, wait = ("succeeded", None), ("failed", None), ("skipped", None), ("running", None)
    assert verdict([ok, skip]) == "run"
    assert verdict([skip, skip]) == "upstream-skipped"
    assert verdict([ok, no]) == "upstream-failed"
    assert verdict([no, wait]) == "wait"
    assert verdict([("failed", "continue")]) == "run"
    assert verdict([("failed", "route")], route="x") == "run"
    assert verdict([("failed", "route")], route="y") == "upstream-failed"
    assert verdict([("cancelled", None)]) == "upstream-failed"
    assert verdict([ok, wait], "any") == "run"
    assert verdict([no, wait], "any") == "wait"
    assert verdict([no, no], "any") == "run"


@pytest.fixture(params=[10_000, 2], ids=["gathered", "by-rounds"])
def row_edges(request, monkeypatch):
    monkeypatch.setattr(df_, "ROW_EDGES", request.param)


def test_plan_graphs(spark, row_edges):
    edges = [("t", "p", *e) for e in [("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "d")]]
    edges += [("t", "q", *e) for e in [("b", "a"), ("c", "b"), ("b", "c"), ("d", "c")]] + [("t", "s", "y", "x")]
    e = spark.createDataFrame(edges, "tenant_id string, plan_hash string, step_id string, depends_on string")
    names = {"p": "abcde", "q": "abcd", "s": "xy", "lone": "z"}
    steps = spark.createDataFrame([("t", p, s, {"p": "public", "q": "internal"}.get(p, "internal") if s != "a" else "secret") for p, ss in names.items() for s in ss], "tenant_id string, plan_hash string, step_id string, sensitivity string")
    assert {r.plan_hash for r in df_.cyclic_plans(e).collect()} == {"q"}
    assert {r.plan_hash: r.depth for r in df_.longest_chains(steps, e).collect()} == {"p": 5, "s": 2, "lone": 1}
    up = {}
    for r in df_.transitive_dependencies(e).collect():
        up.setdefault((r.plan_hash, r.step_id), set()).add(r.depends_on)
    assert up[("p", "e")] == set("abcd") and up[("p", "c")] == set("ab") and up[("q", "b")] == set("abc") and up[("s", "y")] == {"x"}
    sens = {(r.plan_hash, r.step_id): r.sensitivity for r in df_.propagate_sensitivity(steps, e).collect()}
    assert (sens[("p", "e")], sens[("p", "a")], sens[("s", "y")], sens[("lone", "z")]) == ("secret", "secret", "internal", "internal")


def test_account_export_is_one_document(spark):
    t = spark.createDataFrame([("t1", "One"), ("t2", "Two")], "id string, name string").withColumn("created_at", F.expr("timestamp'2026-01-01'"))
    users = spark.createDataFrame([("u1", "t1", "a@x", "A"), ("u2", "t1", "b@x", "B")], "id string, tenant_id string, email string, name string")
    settings = spark.createDataFrame([("t1", "w", True), ("t1", "v", True)], "tenant_id string, name string, enabled boolean")
    versions = spark.createDataFrame([("t1", "w", "1.0.0", "published"), ("t1", "w", "1.1.0", "published"), ("t1", "v", "2.0.0", "published")], "tenant_id string, name string, version string, status string")
    runs = spark.createDataFrame([(f"r{i}", "t1", "w", "succeeded") for i in range(5)], "id string, tenant_id string, workflow_name string, status string")
    lines = ex.account_lines(t, users, settings, versions, runs, F.expr("timestamp'2026-06-01'"))
    docs = {}
    for r in lines.orderBy("tenant_id", "o1", "o2", "o3", "o4").collect():
        docs[r.tenant_id] = docs.get(r.tenant_id, "") + r.line + "\n"
    one, two = json.loads(docs["t1"]), json.loads(docs["t2"])
    assert [p["id"] for p in one["people"]] == ["u1", "u2"] and [r["id"] for r in one["runs"]] == [f"r{i}" for i in range(5)]
    assert [(w["name"], [v["version"] for v in w["versions"]]) for w in one["workflows"]] == [("v", ["2.0.0"]), ("w", ["1.0.0", "1.1.0"])]
    assert (two["workspace"]["id"], two["people"], two["runs"]) == ("t2", [], [])


def test_audit_file_keeps_order(spark, tmp_path):
    rows = chain(40)
    df = spark.createDataFrame([tuple(r) for r in rows], model.schema_of("events"))
    lines = ex.audit_lines(df, ql.verify_chain(df), F.expr("timestamp'2026-06-01'"))
    out = str(tmp_path / "audit")
    ex.write_lines(lines, out, ["seq"], partitions=5)
    import pathlib

    parts = sorted(pathlib.Path(out, "tenant_id=a").glob("part-*"))
    text = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    assert text[0]["_meta"]["chain"] == {"ok": True, "checked": 20}
    assert [x["seq"] for x in text[1:]] == list(range(2, 41, 2))


def test_read_only_guard(spark):
    for bad in ("DELETE FROM x", "select 1; drop table x", "update x set a = 1"):
        with pytest.raises(ValueError):
            xt.check_read_only(bad)
    rows, info = xt.query_source(spark, "/* note */ SELECT id FROM range(10) WHERE id >= :lo", {"lo": 3}, max_rows=4)
    assert (rows.count(), info.first().row_count, info.first().truncated) == (4, 7, True)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "sub" / "b.bin").write_bytes(b"\xff\x00")
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.size) for r in xt.read_files(spark, str(tmp_path), recursive=True).collect()}
    assert got == {"a.txt": ("héllo", 6), "b.bin": (None, 2)}
    assert [r.size for r in xt.list_files(spark, str(tmp_path)).collect()] == [6]
    assert {r.sha256 for r in xt.read_files(spark, str(tmp_path), "base64").collect()} == {hashlib.sha256("héllo".encode()).hexdigest()}
    with pytest.raises(Exception, match="FILE_TOO_LARGE"):
        xt.read_files(spark, str(tmp_path), max_bytes=3).collect()


def test_map_items_isolates_failures(spark):
    df = spark.createDataFrame([("a", [1, 2, 0, 4]), ("b", [])], "id string, xs array<int>")

    def inverse(pdf):
        if (pdf["item"] == 0).any():
            raise ZeroDivisionError("zero")
        return 1 / pdf["item"]

    got = sorted((r["index"], r.ok, r.value, r.message) for r in ex.map_items(df, "xs", ["id"], inverse, "double").collect())
    assert got == [(0, True, 1.0, None), (1, True, 0.5, None), (2, False, None, "zero"), (3, True, 0.25, None)]


def test_lockouts_match_the_sequential_rule(spark):
    import random

    rnd = random.Random(5)
    rows = [(i + 1, "t", f"u{rnd.randrange(3)}", i * 1000, rnd.random() < 0.15) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, tenant_id string, user_id string, ms bigint, ok boolean")
    got = {r.seq: (r.failures, r.locked) for r in sf.lockouts(df, limit=4, rows_per_chunk=50).collect()}
    rules = {}
    for seq, _, u, ms, ok in rows:
        rule = rules.setdefault(u, sf.Lockout(4))
        n, locked, _ = rule.step(type("R", (), {"ok": ok, "ms": ms}))
        assert got[seq] == (n, locked)
