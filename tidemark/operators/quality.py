"""Event checks, audit-chain verification, payload checks, retention and recovery reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark import model
from tidemark.functions.canonical import canonical_json
from tidemark.functions.values import try_json
from tidemark.operators import joins as jn
from tidemark.operators.skew import chunked_lag

C = F.col


def event_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed table of known event types (under a hundred rows)."""
    rows = [(t, run, list(keys)) for t, (run, keys) in model.EVENT_CATALOGUE.items()]
    return spark.createDataFrame(rows, "type string, needs_run boolean, required array<string>")


def validate_events(events: DataFrame) -> DataFrame:
    """First problem of each event: unknown type, missing run id, or a missing data key."""
    cat = F.broadcast(event_catalogue(events.sparkSession))  # fixed, tiny
    e = events.join(cat, "type", "left")
    keys = F.coalesce(F.json_object_keys("data"), F.array().cast("array<string>"))
    missing = F.array_except("required", keys)
    code = (
        F.when(C("required").isNull(), "UNKNOWN_EVENT_TYPE")
        .when(C("needs_run") & (F.coalesce("run_id", F.lit("")) == ""), "MISSING_RUN_ID")
        .when(F.size(missing) > 0, "MISSING_EVENT_FIELD")
    )
    field_ = F.when(code == "MISSING_EVENT_FIELD", F.concat(F.lit("data."), F.try_element_at(missing, F.lit(1)))).when(
        code == "MISSING_RUN_ID", "runId").when(code == "UNKNOWN_EVENT_TYPE", "type")
    return e.withColumn("code", code).withColumn("field", field_).drop("needs_run", "required")


NOTE = "Payload exceeded the event size limit; store large data as an artifact and reference it by hash."


def truncate_payloads(events: DataFrame, limit: int = model.MAX_EVENT_DATA_BYTES) -> DataFrame:
    """Cut payloads above the limit to their required keys, listing what was dropped."""
    cat = F.broadcast(event_catalogue(events.sparkSession).drop("needs_run"))
    e = events.join(cat, "type", "left")
    required = F.coalesce("required", F.array().cast("array<string>"))
    big = F.octet_length("data") > limit
    members = F.from_json(F.when(big, C("data")), "map<string,variant>")
    kept = F.to_json(F.map_filter(members, lambda k, v: F.array_contains(required, k)))
    dropped = F.to_json(F.array_except(F.map_keys(members), required))
    body = F.substring(kept, F.lit(2), F.length(kept) - 2)
    cut = F.concat(
        F.lit("{"), body, F.when(body == "", "").otherwise(","), F.lit('"_truncated":true,"_droppedKeys":'), dropped, F.lit(f',"_note":"{NOTE}"}}'))
    return e.withColumn("truncated", big).withColumn("data", F.when(big, cut).otherwise(C("data"))).drop("required")


def event_content_hash() -> Column:
    """Hash of an event's canonical content, as written when it was appended."""

    def text(c: Column) -> Column:
        js = F.to_json(F.struct(c.alias("v")))
        return F.substring(js, F.lit(6), F.length(js) - 6)

    val = lambda name: F.when(C(name).isNull(), "null").otherwise(text(C(name)))
    members = [
        ("actor", F.coalesce(canonical_json(F.to_json("actor")), F.lit("null"))),
        ("attempt", val("attempt")), ("correlationId", val("correlation_id")),
        ("data", F.coalesce(canonical_json(C("data")), F.lit("{}"))),
        ("id", val("id")), ("prev", text(C("prev_hash"))), ("runId", val("run_id")), ("stepId", val("step_id")),
        ("tenant", val("tenant_id")), ("ts", F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))),
        ("type", val("type")),
    ]
    parts: list[Column] = []
    for i, (k, v) in enumerate(members):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{k}":'), v]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts, F.lit("}")), 256))


LINK_BROKEN, CONTENT_BROKEN = "chain link does not match the previous event", "event content does not match its hash"
HEADS = "tenant_id string, seq bigint, hash string, checked bigint"


def verify_chain(events: DataFrame, content_hash: Column | None = None, genesis: str = model.GENESIS_HASH, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Check every tenant's hash chain: ok, checked, broken_at_seq, reason.  See ``verify_further``."""
    return verify_further(events, None, content_hash, genesis, rows_per_chunk).drop("head_seq", "head_hash")


def verify_further(
    events: DataFrame, heads: DataFrame | None, content_hash: Column | None = None, genesis: str = model.GENESIS_HASH, rows_per_chunk: int = 1_000_000,
) -> DataFrame:
    """Check every tenant's hash chain from its verified head on: ok, checked, broken_at_seq, reason, head_seq, head_hash.

    ``heads`` (see ``HEADS`` and ``verified_heads``) says how far a former run came; events up to there are not read again, a tenant
    without a head is checked from its first event.  Tenants of ``heads`` without new events are reported as they were left.

    The log is read once.  The chain is cut into chunks of the global sequence; each gives one row (its ends, its
    length, its first break inside), and only these rows are put in order per tenant, so one huge tenant still
    verifies in parallel.  A broken link is reported before broken content of the same event.
    """
    want = event_content_hash() if content_hash is None else content_hash
    e = events.withColumn("_want", want).select("tenant_id", "seq", "hash", "prev_hash", C("_want").eqNullSafe(C("hash")).alias("_same"))
    if heads is not None:
        h = heads.select(C("tenant_id").alias("_tenant"), C("seq").alias("_from"))
        e = e.join(h, C("tenant_id").eqNullSafe(C("_tenant")), "left").where(C("_from").isNull() | (C("seq") > C("_from"))).drop("_tenant", "_from")
    e = e.withColumn("_chunk", F.floor(C("seq") / rows_per_chunk))
    w = W.partitionBy("tenant_id", "_chunk").orderBy("seq")
    e = e.withColumn("_at", F.row_number().over(w)).withColumn("_before", F.lag("hash").over(w))
    linked = C("prev_hash").eqNullSafe(C("_before"))
    reason = F.when((C("_at") > 1) & ~linked, LINK_BROKEN).when((C("_at") > 1) & ~C("_same"), CONTENT_BROKEN)
    e = e.withColumn("_reason", reason)
    chunks = e.groupBy("tenant_id", "_chunk").agg(
        F.count("*").alias("_n"), F.min_by(F.struct("seq", "prev_hash", "_same"), "_at").alias("_first"), F.max_by(F.struct("seq", "hash"), "_at").alias("_last"),
        F.min(F.when(C("_reason").isNotNull(), F.struct("seq", "_at", "_reason"))).alias("_inside"))
    if heads is not None:
        past = heads.select("tenant_id", F.lit(None).cast("bigint").alias("_chunk"), C("checked").alias("_n"), F.struct("seq", "hash").alias("_last"))
        chunks = chunks.unionByName(past, allowMissingColumns=True)  # a head is the chunk before all others
    v = W.partitionBy("tenant_id").orderBy(C("_chunk").asc_nulls_first())
    chunks = chunks.withColumn("_done", F.sum("_n").over(v) - C("_n")).withColumn("_hash", F.coalesce(F.lag("_last.hash").over(v), F.lit(genesis)))
    start = F.when(~C("_first.prev_hash").eqNullSafe(C("_hash")), LINK_BROKEN).when(~C("_first._same"), CONTENT_BROKEN)
    start = F.when(C("_first").isNotNull(), start)
    found = F.when(start.isNotNull(), F.struct(C("_first.seq").alias("seq"), C("_done").alias("checked"), start.alias("reason"))).when(
        C("_inside").isNotNull(), F.struct(C("_inside.seq").alias("seq"), (C("_done") + C("_inside._at") - 1).alias("checked"), C("_inside._reason").alias("reason")))
    g = chunks.withColumn("_found", found).groupBy("tenant_id").agg(F.sum("_n").alias("_all"), F.min("_found").alias("_b"), F.max("_last").alias("_end"))
    ok = C("_b").isNull()
    return g.select(
        "tenant_id", ok.alias("ok"), F.coalesce("_b.checked", "_all").alias("checked"), C("_b.seq").alias("broken_at_seq"), C("_b.reason").alias("reason"),
        F.when(ok, C("_end.seq")).alias("head_seq"), F.when(ok, C("_end.hash")).alias("head_hash"))


def verified_heads(result: DataFrame) -> DataFrame:
    """Where the next ``verify_further`` may go on: tenants whose chain held so far; a broken one is checked whole again."""
    return result.where("ok").select("tenant_id", C("head_seq").alias("seq"), C("head_hash").alias("hash"), "checked")


def illegal_transitions(history: DataFrame, rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Status changes the run state machine does not allow: ``seq, run_id, status`` rows in order."""
    spark = history.sparkSession
    legal = [(a, b) for a, targets in model.RUN_TRANSITIONS.items() for b in targets] + [(s, s) for s in model.RUN_STATUSES]
    legal_df = F.broadcast(spark.createDataFrame(legal, "from_status string, status string"))  # fixed, tiny
    h = chunked_lag(history, ["run_id"], "seq", {"status": "from_status"}, rows_per_chunk)
    return h.where(C("from_status").isNotNull()).join(legal_df, ["from_status", "status"], "left_anti")


@dataclass(frozen=True)
class Field:
    """One declared member of a JSON object."""

    type: str  # string, number, integer, boolean, array, object
    required: bool = False
    default: str | None = None  # JSON text
    enum: Sequence[str] | None = None
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_items: int | None = None
    max_items: int | None = None
    fields: Mapping[str, "Field"] = field(default_factory=dict)


def _path(path: Sequence[str]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def _issue(cond: Column, path: Sequence[str], code: str, message: str) -> Column:
    row = F.struct(F.lit(".".join(path)).alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"))
    return F.when(cond, row)


def _field_issues(doc: Column, path: list[str], f: Field) -> list[Column]:
    name = path[-1]
    node = F.try_variant_get(doc, _path(path), "variant")
    kind = F.schema_of_variant(node)
    text = F.try_variant_get(doc, _path(path), "string")
    number = F.try_variant_get(doc, _path(path), "double")
    there = node.isNotNull()
    is_num = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    fits = {
        "string": kind == "STRING", "number": is_num, "integer": is_num & (number == F.floor(number)), "boolean": kind == "BOOLEAN",
        "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT"),
    }[f.type]
    out = [_issue(there & ~fits, path, "type", f"'{name}' must be {f.type}")]
    if f.required and f.default is None:
        out.append(_issue(~there, path, "required", f"'{name}' is required"))
    ok = there & fits
    if f.enum is not None:
        out.append(_issue(ok & ~text.isin(*f.enum), path, "enum", f"'{name}' is not an allowed value"))
    if f.pattern is not None:
        out.append(_issue(ok & ~text.rlike(f.pattern), path, "pattern", f"'{name}' does not match its pattern"))
    for limit, bad, code in (
        (f.minimum, lambda v: number < v, "minimum"), (f.maximum, lambda v: number > v, "maximum"),
        (f.min_length, lambda v: F.length(text) < v, "minLength"), (f.max_length, lambda v: F.length(text) > v, "maxLength"),
        (f.min_items, lambda v: F.json_array_length(text) < v, "minItems"), (f.max_items, lambda v: F.json_array_length(text) > v, "maxItems"),
    ):
        if limit is not None:
            out.append(_issue(ok & bad(limit), path, code, f"'{name}' breaks {code} {limit}"))
    if f.fields:
        for child, spec in f.fields.items():
            out += [F.when(ok, i) for i in _field_issues(doc, [*path, child], spec)]
        out.append(_unknown(F.when(ok, text), path, f.fields))
    return out


def _unknown(text: Column, path: Sequence[str], fields: Mapping[str, Field]) -> Column:
    extra = F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in fields]))
    row = F.struct(F.lit(".".join(path)).alias("path"), F.lit("additionalProperties").alias("code"),
                   F.concat(F.lit("unknown member(s): "), F.array_join(extra, ", ")).alias("message"))
    return F.when(F.size(extra) > 0, row)


def validate_json(df: DataFrame, column: str, fields: Mapping[str, Field], max_string: int | None = None) -> DataFrame:
    """All problems of a JSON object against its declared members, and the object with defaults filled in.

    Closed schema, no coercion; a text member without a limit gets ``max_string`` if that is given.
    """
    bounded = {k: Field(**{**f.__dict__, "max_length": max_string}) if max_string is not None and f.type == "string" and f.max_length is None else f for k, f in fields.items()}
    doc = try_json(C(column))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    checks = [_issue(~is_object, ["$"], "type", "not a JSON object")]
    for name, spec in bounded.items():
        checks += [F.when(is_object, i) for i in _field_issues(doc, [name], spec)]
    checks.append(F.when(is_object, _unknown(C(column), ["$"], bounded)))
    issues = F.filter(F.array(*checks), lambda i: i.isNotNull())
    filled = F.when(is_object, C(column))
    for name, spec in bounded.items():
        if spec.default is not None:
            absent = F.try_variant_get(doc, _path([name]), "variant").isNull()
            body = F.rtrim(F.substring(F.rtrim(filled), F.lit(1), F.length(F.rtrim(filled)) - 1))
            comma = F.when(body.endswith("{"), "").otherwise(",")
            filled = F.when(absent, F.concat(body, comma, F.lit(f'"{name}":{spec.default}}}'))).otherwise(filled)
    return df.withColumn("issues", issues).withColumn("filled", filled)


def retention_candidates(artifacts: DataFrame, tenants: DataFrame, users: DataFrame, runs: DataFrame, account_runs: DataFrame, versions: DataFrame, outbox: DataFrame, deliveries: DataFrame, cutoff: Column) -> DataFrame:
    """Everything retention may erase, as (kind, tenant_id, id).  Events and runs never appear."""
    art = jn.expired_artifacts(artifacts, runs, cutoff).select(F.lit("artifact").alias("kind"), "tenant_id", C("hash").alias("id"))
    acc = jn.stale_unconfirmed_tenants(tenants, users, account_runs, versions, cutoff).select(F.lit("account").alias("kind"), C("id").alias("tenant_id"), "id")
    out = outbox.where(C("sent_at") < cutoff).select(F.lit("outbox").alias("kind"), "tenant_id", "id")
    dlv = deliveries.where((C("status") != "pending") & (C("created_at") < cutoff)).select(F.lit("delivery").alias("kind"), "tenant_id", "id")
    return art.unionByName(acc).unionByName(out).unionByName(dlv)


def purge_tenants(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given tenants (column ``tenant_id``); events keep their record.

    Tables that reach the tenant through a parent lose the parent's children.
    """
    gone = gone.select("tenant_id").distinct()
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if name == "events":
            out[name] = df
        elif name == "tenants":
            out[name] = df.join(gone.withColumnRenamed("tenant_id", "id"), "id", "left_anti")
        elif name == "step_states":
            lost = tables["runs"].join(gone, "tenant_id", "left_semi").select(C("id").alias("run_id"))
            out[name] = df.join(lost, "run_id", "left_anti")
        elif name == "trigger_fires":
            lost = tables["triggers"].join(gone, "tenant_id", "left_semi").select(C("id").alias("trigger_id"))
            out[name] = df.join(lost, "trigger_id", "left_anti")
        else:
            out[name] = df.join(gone, "tenant_id", "left_anti")
    return out


def orphaned_steps(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps left marked running in open runs, with the attempt they go back to."""
    open_runs = runs.where(C("status").isin(*model.ACTIVE_RUN))
    j = jn.steps_of_runs(steps.where((C("status") == "running") | (C("compensation_status") == "running")), open_runs)
    was_running = C("status") == "running"
    return j.select(
        "tenant_id", "run_id", "step_id",
        F.when(was_running, "retry-wait").otherwise(C("status")).alias("new_status"),
        F.when(was_running, F.greatest(F.lit(0), C("attempt") - 1)).otherwise(C("attempt")).alias("new_attempt"),
        F.when(C("compensation_status") == "running", "pending").otherwise(C("compensation_status")).alias("new_compensation"),
    )


def step_readiness(steps: DataFrame, edges: DataFrame, modes: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Verdict for each pending step: run, wait, upstream-failed or upstream-skipped.

    ``steps``: run_id, plan_hash, step_id, status, handled.  ``modes``: plan_hash,
    step_id, mode of parallel joins.  ``routes``: plan_hash, depends_on, route_to of
    steps whose failure releases one named step only.
    """
    pending = steps.where("status = 'pending'").select("run_id", "plan_hash", "step_id")
    deps = jn.dependency_states(steps, edges).where("status = 'pending'")
    if routes is None:
        released = F.lit(False)
    else:
        deps = deps.join(routes.select("plan_hash", "depends_on", "route_to"), ["plan_hash", "depends_on"], "left")
        released = F.coalesce(C("route_to") == C("step_id"), F.lit(False))
    s, handled = C("dep_status"), C("dep_handled")
    outcome = (
        F.when(s == "succeeded", "ok").when(s == "skipped", "skipped")
        .when((s == "failed") & (handled == "continue"), "ok")
        .when((s == "failed") & (handled == "route") & released, "ok")
        .otherwise("blocked")
    )
    g = deps.withColumn("outcome", outcome).groupBy("run_id", "plan_hash", "step_id").agg(
        F.bool_and(s.isin(*model.TERMINAL_STEP)).alias("done"), F.bool_or(s == "succeeded").alias("any_ok"),
        F.bool_or(C("outcome") == "blocked").alias("blocked"), F.bool_and(C("outcome") == "skipped").alias("all_skipped"),
    )
    j = pending.join(g, ["run_id", "plan_hash", "step_id"], "left")
    if modes is None:
        j = j.withColumn("mode", F.lit("all"))
    else:
        j = j.join(modes.select("plan_hash", "step_id", "mode"), ["plan_hash", "step_id"], "left")
    first_wins = F.coalesce(C("mode") == "any", F.lit(False))
    verdict = (
        F.when(C("done").isNull(), "run")
        .when(first_wins, F.when(C("any_ok") | C("done"), "run").otherwise("wait"))
        .when(~C("done"), "wait")
        .when(C("blocked"), "upstream-failed")
        .when(C("all_skipped"), "upstream-skipped")
        .otherwise("run")
    )
    return j.select("run_id", "step_id", verdict.alias("verdict"))


def run_step_summary(steps: DataFrame) -> DataFrame:
    """Unhandled failures, and whether every step is final, per run."""
    bad = (C("status") == "failed") & (F.coalesce("handled", F.lit("")) == "")
    return steps.groupBy("run_id").agg(
        F.count_if(bad).alias("unhandled_failures"), F.bool_and(C("status").isin(*model.TERMINAL_STEP)).alias("all_terminal"))
