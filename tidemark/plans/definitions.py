"""Static analysis of workflow definitions over plan_steps and plan_edges.

Graph questions are answered for all plans at once.  A plan is one document, so
its edges normally fit in a row: they are gathered by one shuffle and walked
where they lie.  Plans with more than ``ROW_EDGES`` edges are never gathered;
they are walked by equality joins on (plan, step), one round per dependency
level, with every round's result written to the shared folder.
"""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import patterns as pt
from tidemark.functions import text as tx
from tidemark.session import cut_lineage

C = F.col
PLAN = ["tenant_id", "plan_hash"]
# Platform limits of one definition
MAX_MAP_ITEMS = 100_000
MAX_INVOCATIONS = 250_000


def sensitivity_rank(level: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in enumerate(model.SENSITIVITY) for x in reversed(kv)])
    return F.element_at(m, level)


def sensitivity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in model.SENSITIVITY]), rank + 1)


def plan_rollup(plan_steps: DataFrame) -> DataFrame:
    """Effects by class, sets of scopes / egress / families / capabilities, highest sensitivity, fan-out, flags.

    The sets are of names declared in one plan document.
    """
    called = C("capability").isNotNull() & C("type").isin("capability", "map")
    set_of = lambda c: F.array_sort(F.collect_set(c))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    n = lambda e: F.count_if(called & (C("effect") == e))
    return plan_steps.groupBy(*PLAN).agg(
        F.count("*").alias("step_count"), n("pure").alias("pure"), n("idempotent").alias("idempotent"), n("effectful").alias("effectful"),
        flat(F.when(called, C("scopes"))).alias("scopes"), flat("egress").alias("egress"),
        set_of(F.when(called, C("family"))).alias("families"), set_of(F.when(called, C("capability"))).alias("capabilities"),
        sensitivity_name(F.max(sensitivity_rank(C("sensitivity")))).alias("max_sensitivity"),
        F.max(F.when(called, F.when(C("type") == "map", C("max_items")).otherwise(1))).alias("max_fan_out"),
        F.bool_or(C("type") == "approval").alias("has_approval"), F.bool_or("has_compensation").alias("has_compensation"),
    )


def plan_cost(plan_steps: DataFrame) -> DataFrame:
    """Invocations, estimated cost and worst-case cost of one run of each plan."""
    called = C("type").isin("capability", "map")
    calls = F.when(C("type") == "map", C("max_items").cast("bigint")).otherwise(F.lit(1))
    units = F.coalesce("units", F.lit(0.0))
    return plan_steps.where(called).groupBy(*PLAN).agg(
        F.sum(calls).alias("max_invocations"), F.sum(units * calls).alias("estimated_cost"),
        F.sum(units * calls * F.coalesce("retry_attempts", F.lit(1))).alias("max_cost"),
    )


def add_children(cost: DataFrame, children: DataFrame) -> DataFrame:
    """Add the totals of sub-workflows: ``children`` has tenant_id, plan_hash, child_plan_hash (one row per call)."""
    child = cost.select("tenant_id", C("plan_hash").alias("child_plan_hash"), *[C(c).alias(f"_{c}") for c in ("max_invocations", "estimated_cost", "max_cost")])
    extra = children.join(child, ["tenant_id", "child_plan_hash"]).groupBy(*PLAN).agg(
        *[F.sum(f"_{c}").alias(f"_{c}") for c in ("max_invocations", "estimated_cost", "max_cost")])
    j = cost.join(extra, PLAN, "left")
    return j.select(*PLAN, *[(C(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("max_invocations", "estimated_cost", "max_cost")])


def limit_checks(plan_steps: DataFrame, ceilings: DataFrame | None = None) -> DataFrame:
    """Definitions beyond the limits: (plan, code, value)."""
    cost = plan_cost(plan_steps)
    fan = plan_steps.where((C("type") == "map") & (C("max_items") > MAX_MAP_ITEMS)).select(*PLAN, F.lit("FANOUT_TOO_LARGE").alias("code"), C("max_items").cast("double").alias("value"))
    many = cost.where(C("max_invocations") > MAX_INVOCATIONS).select(*PLAN, F.lit("TOO_MANY_INVOCATIONS").alias("code"), C("max_invocations").cast("double").alias("value"))
    out = fan.unionByName(many)
    if ceilings is None:
        return out
    j = cost.join(ceilings, PLAN)
    low = C("estimated_cost") > C("max_run_cost")
    code = F.when(low, "COST_CEILING_TOO_LOW").when(C("max_cost") > C("max_run_cost"), "COST_MAY_EXCEED_CEILING")
    hit = j.withColumn("code", code).where(C("code").isNotNull())
    return out.unionByName(hit.select(*PLAN, "code", F.when(low, C("estimated_cost")).otherwise(C("max_cost")).alias("value")))


ROW_EDGES = 10_000


def _split(plan_edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(one row per ordinary plan with its edges, edges of oversized plans or None)."""
    edges = plan_edges.select(*PLAN, "step_id", "depends_on")
    sizes = edges.groupBy(*PLAN).agg(F.count("*").alias("n"))
    huge = sizes.where(C("n") > ROW_EDGES).select(*PLAN)
    if huge.isEmpty():
        ordinary, rest = edges, None
    else:
        ordinary, rest = edges.join(huge, PLAN, "left_anti"), edges.join(huge, PLAN, "left_semi").distinct()
    rows = ordinary.groupBy(*PLAN).agg(F.collect_set(F.struct("step_id", "depends_on")).alias("edges"))
    return rows.select(*PLAN, F.transform("edges", lambda e: e["step_id"]).alias("steps"), F.transform("edges", lambda e: e["depends_on"]).alias("deps")), rest


def _levels(steps, deps) -> tuple[dict[str, int], list[str]]:
    """Depth of every step, dependencies first, and the steps on or behind a cycle."""
    needs: dict[str, int] = {}
    followers: dict[str, list[str]] = {}
    for s, d in zip(steps, deps):
        needs[s] = needs.get(s, 0) + 1
        needs.setdefault(d, 0)
        followers.setdefault(d, []).append(s)
    depth = {s: 1 for s, n in needs.items() if n == 0}
    queue = list(depth)
    for s in queue:
        for f in followers.get(s, ()):
            needs[f] -= 1
            depth[f] = max(depth.get(f, 1), depth[s] + 1)
            if needs[f] == 0:
                queue.append(f)
    done = set(queue)
    return {s: depth[s] for s in queue}, [s for s in needs if s not in done]


def _row_depths(steps: Column, deps: Column) -> Column:
    @F.pandas_udf("depth int, stuck int")
    def run(s: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = [_levels(a, b) for a, b in zip(s, d)]
        return pd.DataFrame({"depth": [max(x[0].values(), default=0) for x in out], "stuck": [len(x[1]) for x in out]})

    return run(steps, deps)


def _row_closure(steps: Column, deps: Column) -> Column:
    """All (step, upstream) pairs of one plan, as two parallel arrays."""
    @F.pandas_udf("step array<string>, up array<string>")
    def run(s: pd.Series, d: pd.Series) -> pd.DataFrame:
        left, right = [], []
        for a, b in zip(s, d):
            direct: dict[str, set[str]] = {}
            for x, y in zip(a, b):
                direct.setdefault(x, set()).add(y)
            xs: list[str] = []
            ys: list[str] = []
            for x in direct:
                seen, todo = set(), list(direct[x])
                while todo:
                    y = todo.pop()
                    if y not in seen:
                        seen.add(y)
                        todo.extend(direct.get(y, ()))
                xs += [x] * len(seen)
                ys += seen
            left.append(xs)
            right.append(ys)
        return pd.DataFrame({"step": left, "up": right})

    return run(steps, deps)


def cyclic_plans(plan_edges: DataFrame) -> DataFrame:
    """Plans whose dependencies contain a cycle: some steps can never be reached."""
    rows, rest = _split(plan_edges)
    out = rows.select(*PLAN, _row_depths(C("steps"), C("deps")).alias("g")).where("g.stuck > 0").select(*PLAN)
    return out if rest is None else out.unionByName(_peel(rest)[1].select(*PLAN).distinct())


def _peel(plan_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For oversized plans: (steps with their depth, edges that can never be released).

    Each round removes the steps that depend on nothing left.
    """
    edges = plan_edges.select(*PLAN, "step_id", "depends_on").distinct()
    waiting = cut_lineage(edges, "edges")
    steps = waiting.select(*PLAN, "step_id").unionByName(waiting.select(*PLAN, C("depends_on").alias("step_id"))).distinct()
    ready = steps.join(waiting.select(*PLAN, "step_id").distinct(), [*PLAN, "step_id"], "left_anti").withColumn("depth", F.lit(1))
    done, n = ready, waiting.count()
    for level in count(2):  # ends when a round releases nothing
        # an edge is released once the step it depends on has a depth
        freed = ready.select(*PLAN, C("step_id").alias("depends_on"))
        left = cut_lineage(waiting.join(freed, [*PLAN, "depends_on"], "left_anti"), "edges")
        now = left.count()
        if now == n:
            return done, left
        held = left.select(*PLAN, "step_id").distinct()
        ready = waiting.select(*PLAN, "step_id").distinct().join(held, [*PLAN, "step_id"], "left_anti").withColumn("depth", F.lit(level))
        done, waiting, n = done.unionByName(ready), left, now
        if level % 20 == 0:  # keeps the plan of a long chain short
            done, ready = cut_lineage(done, "depths"), cut_lineage(ready, "ready")
        if n == 0:
            return done, left


def longest_chains(plan_steps: DataFrame, plan_edges: DataFrame) -> DataFrame:
    """Steps on the longest dependency chain of each acyclic plan."""
    rows, rest = _split(plan_edges)
    known = rows.select(*PLAN, _row_depths(C("steps"), C("deps")).alias("g")).select(*PLAN, "g.depth", (C("g.stuck") > 0).alias("cyclic"))
    if rest is not None:
        depths, stuck = _peel(rest)
        huge = depths.groupBy(*PLAN).agg(F.max("depth").alias("depth"))
        bad = stuck.select(*PLAN).distinct().withColumn("cyclic", F.lit(True))
        known = known.unionByName(huge.join(bad, PLAN, "full_outer").select(*PLAN, "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic")))
    plans = plan_steps.select(*PLAN).distinct().join(known, PLAN, "left")
    return plans.where(~F.coalesce("cyclic", F.lit(False))).select(*PLAN, F.coalesce("depth", F.lit(1)).alias("depth"))


def transitive_dependencies(plan_edges: DataFrame) -> DataFrame:
    """Every (step, upstream step) pair, reached directly or through others."""
    rows, rest = _split(plan_edges)
    pairs = rows.select(*PLAN, _row_closure(C("steps"), C("deps")).alias("g")).select(*PLAN, F.explode(F.arrays_zip("g.step", "g.up")).alias("p"))
    out = pairs.select(*PLAN, C("p.step").alias("step_id"), C("p.up").alias("depends_on"))
    return out if rest is None else out.unionByName(_doubled(rest))


def _doubled(plan_edges: DataFrame) -> DataFrame:
    """Reachability of oversized plans by path doubling: each round doubles the distance covered."""
    reach = cut_lineage(plan_edges.select(*PLAN, "step_id", "depends_on").distinct(), "reach")
    n = reach.count()
    while True:
        mid = reach.select(*PLAN, C("step_id").alias("depends_on"), C("depends_on").alias("further"))
        longer = reach.join(mid, [*PLAN, "depends_on"]).select(*PLAN, "step_id", C("further").alias("depends_on"))
        reach = cut_lineage(reach.unionByName(longer).distinct(), "reach")
        now = reach.count()
        if now == n:
            return reach
        n = now


def _row_spread(steps: Column, deps: Column, names: Column, ranks: Column) -> Column:
    """The highest rank that reaches each step of one plan: every edge is walked once, highest ranks first."""
    @F.pandas_udf("step array<string>, read array<int>")
    def run(s: pd.Series, d: pd.Series, n: pd.Series, r: pd.Series) -> pd.DataFrame:
        left, right = [], []
        for a, b, own, rank in zip(s, d, n, r):
            readers: dict[str, list[str]] = {}
            for x, y in zip(a, b):
                readers.setdefault(y, []).append(x)
            read: dict[str, int] = {}
            for level, name in sorted(((int(k), x) for x, k in zip(own, rank)), reverse=True):
                todo = [name]
                while todo:
                    for x in readers.get(todo.pop(), ()):
                        if x not in read:
                            read[x] = level
                            todo.append(x)
            left.append(list(read))
            right.append(list(read.values()))
        return pd.DataFrame({"step": left, "read": right})

    return run(steps, deps, names, ranks)


def _spread(ranks: DataFrame, references: DataFrame) -> DataFrame:
    """The same for oversized plans, level by level: only steps whose rank has risen pass it on."""
    edges = cut_lineage(references.select(*PLAN, "step_id", "depends_on").distinct(), "edges")
    best = None
    front = ranks.join(edges.select(*PLAN).distinct(), PLAN, "left_semi")
    while True:
        given = front.select(*PLAN, C("step_id").alias("depends_on"), "read")
        next_ = edges.join(given, [*PLAN, "depends_on"]).groupBy(*PLAN, "step_id").agg(F.max("read").alias("read"))
        if best is None:
            best = front = cut_lineage(next_, "spread")
        else:
            risen = next_.join(best.withColumnRenamed("read", "had"), [*PLAN, "step_id"], "left").where("had IS NULL OR read > had")
            front = cut_lineage(risen.select(*PLAN, "step_id", "read"), "spread")
            best = cut_lineage(best.unionByName(front).groupBy(*PLAN, "step_id").agg(F.max("read").alias("read")), "spread")
        if front.isEmpty():
            return best


def propagate_sensitivity(plan_steps: DataFrame, references: DataFrame) -> DataFrame:
    """Effective sensitivity: the highest of the step's own and everything it reads, directly or through others."""
    own = plan_steps.select(*PLAN, "step_id", sensitivity_rank(F.coalesce("sensitivity", F.lit("internal"))).alias("own"))
    rows, rest = _split(references)
    known = own.groupBy(*PLAN).agg(F.collect_list("step_id").alias("names"), F.collect_list("own").alias("ranks"))
    spread = rows.join(known, PLAN).select(*PLAN, _row_spread(C("steps"), C("deps"), C("names"), C("ranks")).alias("g"))
    most = spread.select(*PLAN, F.explode(F.arrays_zip("g.step", "g.read")).alias("p")).select(*PLAN, C("p.step").alias("step_id"), C("p.read").alias("read"))
    if rest is not None:
        most = most.unionByName(_spread(own.withColumnRenamed("own", "read"), rest))
    j = own.join(most, [*PLAN, "step_id"], "left")
    return j.select(*PLAN, "step_id", sensitivity_name(F.greatest("own", F.coalesce("read", "own"))).alias("sensitivity"))


# ------------------------------------------------------------------ risk rules
# Weight of each severity, and the score levels
WEIGHT = {"info": 0, "low": 3, "medium": 8, "high": 20, "critical": 40}
RISK = ["tenant_id", "plan_hash", "rule", "severity", "blocking", "step_id", "path", "message"]


def _risk(df: DataFrame, rule: Column | str, severity: Column | str, message: Column, blocking: Column | bool = False, step: bool = True, path: Column | None = None) -> DataFrame:
    col = lambda v: F.lit(v) if isinstance(v, (str, bool)) else v
    none = F.lit(None).cast("string")
    return df.select(
        *PLAN, col(rule).alias("rule"), col(severity).alias("severity"), col(blocking).alias("blocking"),
        (C("step_id") if step else none).alias("step_id"), (none if path is None else path).alias("path"), message.alias("message"))


def _strings(plan_steps: DataFrame) -> DataFrame:
    """Every parameter text of every step."""
    return plan_steps.select(*PLAN, "step_id", "type", F.explode("with").alias("name", "value")).where(C("value").isNotNull()).withColumn(
        "path", F.concat_ws(".", "step_id", F.lit("with"), "name"))


def secret_literals(plan_steps: DataFrame) -> DataFrame:
    s = _strings(plan_steps).where(tx.has_secret(C("value")))
    return _risk(s, "PT-SECRET-001", "critical", F.lit("A credential-shaped value is written into the definition."), True, step=False, path=C("path"))


def instruction_text(plan_steps: DataFrame, by_agent: bool = False) -> DataFrame:
    m = _strings(plan_steps).select(*PLAN, "step_id", "path", F.explode(tx.injection_matches(C("value"))).alias("m"))
    kind, sev = C("m.pattern"), C("m.severity")
    rule = F.when(kind == "hidden-unicode", "PT-UNICODE-001").otherwise("PT-INJ-001")
    shown = sev if by_agent else F.when(kind == "encoded-blob", "low").otherwise(sev)
    block = (sev == "critical") | (kind == "hidden-unicode") | (F.lit(by_agent) & (sev != "medium"))
    return _risk(m, rule, shown, F.concat(F.lit("Instruction-shaped or hidden text ("), kind, F.lit("): "), C("m.excerpt")), block, step=False, path=C("path"))


def shell_risks(plan_steps: DataFrame) -> DataFrame:
    s = plan_steps.where((C("family") == "shell") & C("type").isin("capability", "map"))
    exe = F.lower(F.element_at(F.split(F.try_element_at("argv", F.lit(1)), "/"), -1))
    flag = F.lower(F.coalesce(F.try_element_at("argv", F.lit(2)), F.lit("")))
    joined = F.array_join("argv", " ")
    a = _risk(s, "PT-SHELL-001", "medium", F.concat(F.lit("Step "), C("step_id"), F.lit(" runs a shell command.")))
    b = _risk(s.where(exe.isin(*pt.SHELLS) & flag.isin(*pt.SHELL_FLAGS)), "PT-SHELL-002", "critical", F.concat(exe, F.lit(" "), flag, F.lit(" runs a shell string.")), True)
    c = _risk(s.where(joined.rlike(pt.for_java(pt.SHELL_DANGER))), "PT-SHELL-003", "critical", F.lit("Destructive or remote-code pattern in shell arguments."), True)
    return a.unionByName(b).unionByName(c)


def network_risks(plan_steps: DataFrame) -> DataFrame:
    work = plan_steps.where(C("type").isin("capability", "map"))
    e = work.select(*PLAN, "step_id", F.explode("egress").alias("host"))
    bare = F.regexp_replace("host", r":\d+$", "")
    wild = _risk(e.where(C("host").startswith("*.")), "PT-NET-001", "low", F.concat(F.lit("Wildcard egress "), C("host"), F.lit(" allows every subdomain.")))
    raw = _risk(e.where(bare.rlike("(?i)" + pt.IP_LITERAL)), "PT-NET-003", "medium", F.concat(F.lit("Egress to the raw address "), C("host"), F.lit(".")))
    host = F.lower(F.regexp_extract("value", r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    u = _strings(work).withColumn("host", host).where(C("host") != "")
    meta = C("host").rlike("(?i)" + pt.METADATA_HOST)
    inside = C("host").rlike("(?i)" + pt.INTERNAL_HOST)
    target = _risk(
        u.where(meta | inside), "PT-NET-002", F.when(meta, "critical").otherwise("high"),
        F.concat(F.when(meta, "Targets a cloud metadata endpoint (").otherwise("Targets an internal address ("), C("host"), F.lit(").")), meta, path=C("path"))
    return wild.unionByName(raw).unionByName(target)


def effect_risks(plan_steps: DataFrame, criticality: DataFrame | None = None) -> DataFrame:
    s = plan_steps.where(C("type").isin("capability", "map") & (C("effect") == "effectful"))
    s = s.withColumn("criticality", F.lit("low")) if criticality is None else s.join(criticality, PLAN, "left")
    sev = F.when(C("criticality").isin("high", "critical"), "medium").otherwise("low")
    a = _risk(s.where(~F.coalesce("has_compensation", F.lit(False))), "PT-EFFECT-001", sev, F.concat(F.lit("Effectful step "), C("step_id"), F.lit(" has no compensation.")))
    b = _risk(s.where(C("retry_attempts") > 5), "PT-EFFECT-002", "low", F.concat(C("retry_attempts").cast("string"), F.lit(" retry attempts on an effectful step.")))
    return a.unionByName(b)


def model_flow_risks(plan_steps: DataFrame, references: DataFrame) -> DataFrame:
    """Outside content that reaches a model step, and model output that drives an effect."""
    facts = plan_steps.select(*PLAN, "step_id", "type", "family", "effect")
    src = facts.select(*PLAN, C("step_id").alias("depends_on"), C("family").alias("source_family"))
    j = references.select(*PLAN, "step_id", "depends_on").distinct().join(facts.where(C("type").isin("capability", "map")), [*PLAN, "step_id"]).join(src, [*PLAN, "depends_on"])
    into = j.where((C("family") == "llm") & C("source_family").isin("http", "shell", "storage", "database")).select(*PLAN, "step_id").distinct()
    drives = j.where((C("effect") == "effectful") & (C("source_family") == "llm"))
    a = _risk(into, "PT-LLM-001", "info", F.lit("External content reaches a model step."))
    b = _risk(drives, "PT-LLM-002", "high", F.concat(F.lit("Output of model step "), C("depends_on"), F.lit(" flows into effectful step "), C("step_id"), F.lit(".")))
    return a.unionByName(b)


def approval_risks(plan_steps: DataFrame) -> DataFrame:
    s = plan_steps.where(C("type") == "approval")
    a = _risk(s.where(C("on_timeout") == "approve"), "PT-APPR-001", "high", F.concat(F.lit("Gate "), C("step_id"), F.lit(" approves on timeout.")))
    b = _risk(s.where("allow_self"), "PT-APPR-002", "medium", F.concat(F.lit("Gate "), C("step_id"), F.lit(" lets the initiator approve.")))
    return a.unionByName(b)


# Scope pairs that add up to more than their parts
SCOPE_PAIRS = [
    ("db:read", "network:http", "medium", "reads data and can send it over the network"),
    ("storage:read", "network:http", "medium", "reads files and can send them over the network"),
    ("process:exec", "network:http", "high", "runs processes and reaches the network"),
    ("process:exec", "db:write", "high", "runs processes and writes to the database"),
]


def scope_risks(plan_steps: DataFrame) -> DataFrame:
    r = plan_rollup(plan_steps).select(*PLAN, "scopes")
    pairs = F.array(*[F.struct(F.array(F.lit(a), F.lit(b)).alias("need"), F.lit(s).alias("sev"), F.lit(w).alias("why")) for a, b, s, w in SCOPE_PAIRS])
    m = r.select(*PLAN, F.explode(F.filter(pairs, lambda p: F.size(F.array_except(p["need"], C("scopes"))) == 0)).alias("p"))
    return _risk(m, "PT-SCOPE-001", C("p.sev"), F.concat(F.array_join("p.need", " + "), F.lit(": "), C("p.why")), step=False)


def plan_risks(plan_steps: DataFrame, plans: DataFrame) -> DataFrame:
    """Whole-plan checks.  ``plans``: plan key, criticality, data_residency (array), has_failure_alert."""
    j = plan_rollup(plan_steps).join(plan_cost(plan_steps), PLAN, "left").join(plans, PLAN)
    crit = C("criticality").isin("high", "critical")
    fan = _risk(plan_steps.where((C("type") == "map") & (C("max_items") >= 10_000)), "PT-FAN-001", "medium", F.concat(F.lit("Fan-out of up to "), C("max_items").cast("string"), F.lit(" items.")))
    many = _risk(j.where(C("max_invocations") >= 50_000), "PT-FAN-002", "high", F.concat(F.lit("One run may make "), C("max_invocations").cast("string"), F.lit(" calls.")), step=False)
    appr = _risk(j.where(crit & (C("effectful") > 0) & ~C("has_approval")), "PT-APPR-003", "low", F.lit("A critical workflow performs effects without an approval step."), step=False)
    data = _risk(j.where(C("max_sensitivity").isin("confidential", "secret") & (F.size("data_residency") == 0)), "PT-DATA-001", "low", F.concat(F.lit("Handles "), C("max_sensitivity"), F.lit(" data but declares no residency.")), step=False)
    meta = _risk(j.where((C("criticality") == "critical") & ~C("has_failure_alert")), "PT-META-001", "low", F.lit("A critical workflow has no failure alert."), step=False)
    return fan.unionByName(many).unionByName(appr).unionByName(data).unionByName(meta)


def all_risks(plan_steps: DataFrame, references: DataFrame, plans: DataFrame) -> DataFrame:
    plan_steps = cut_lineage(plan_steps, "plan-steps")  # read by every rule
    crit = plans.select(*PLAN, "criticality")
    out = secret_literals(plan_steps)
    for part in (instruction_text(plan_steps), shell_risks(plan_steps), network_risks(plan_steps), effect_risks(plan_steps, crit),
                 model_flow_risks(plan_steps, references), approval_risks(plan_steps), scope_risks(plan_steps), plan_risks(plan_steps, plans)):
        out = out.unionByName(part)
    return out


def risk_scores(risks: DataFrame) -> DataFrame:
    """Score (0 to 100), level and blocking flag per plan; equal findings count once."""
    unique = risks.dropDuplicates([*PLAN, "rule", "path", "step_id", "message"])
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])
    g = unique.groupBy(*PLAN).agg(F.count("*").alias("findings"), F.sum(F.element_at(weight, C("severity"))).alias("_sum"), F.bool_or("blocking").alias("blocking"))
    score = F.least(F.lit(100), C("_sum"))
    level = F.when(score >= 60, "critical").when(score >= 35, "high").when(score >= 15, "medium").otherwise("low")
    return g.select(*PLAN, "findings", score.alias("score"), level.alias("level"), "blocking")
