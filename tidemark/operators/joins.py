"""Joins between history tables.

No side is broadcast by hint here: adaptive execution measures both sides and
broadcasts one only when it is really small, and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import filters as flt


def steps_of_runs(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Step states with the tenant and workflow of their run."""
    return steps.join(runs.select(F.col("id").alias("run_id"), "tenant_id", "workflow_name"), "run_id")


def last_activity(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Newest sign of life per run; a run without steps falls back to its own times."""
    newest = steps.groupBy("run_id").agg(F.max("updated_at").alias("step_time"), F.bool_or(F.col("updated_at").isNull()).alias("gap"))
    own = F.coalesce("started_at", "created_at")
    j = runs.join(newest, F.col("id") == F.col("run_id"), "left")
    # a step without an update time counts as the run's own time
    last = F.when(F.col("step_time").isNull(), own).when(F.col("gap"), F.greatest("step_time", own)).otherwise(F.col("step_time"))
    return j.select("tenant_id", "id", "workflow_name", last.alias("last_activity"))


def without_live_step(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with no step in flight or legitimately waiting."""
    live = steps.where(F.col("status").isin(*model.LIVE_STEP)).select(F.col("run_id").alias("_live"))
    return runs.join(live, F.col("id") == F.col("_live"), "left_anti")


def stale_unconfirmed_tenants(tenants: DataFrame, users: DataFrame, runs: DataFrame, versions: DataFrame, cutoff: Column) -> DataFrame:
    """Self-made accounts nobody confirmed and that never did anything."""
    old = tenants.where(F.col("id").startswith("acct-") & (F.col("created_at") < cutoff))
    own = lambda df: df.select(F.col("tenant_id").alias("_t"))
    same = F.col("id") == F.col("_t")
    return (
        old.join(own(users.where("email_unverified")), same, "left_semi")
        .join(own(users.where("NOT email_unverified")), same, "left_anti")
        .join(own(runs), same, "left_anti")
        .join(own(versions), same, "left_anti")
    )


def expired_artifacts(artifacts: DataFrame, runs: DataFrame, cutoff: Column) -> DataFrame:
    """Live artifacts whose run reached a final state before the cutoff."""
    done = runs.where(flt.is_terminal(F.col("status")) & (F.col("finished_at") < cutoff)).select(
        F.col("id").alias("run_id"), "finished_at"
    )
    return artifacts.where(F.col("tombstoned_at").isNull()).join(done, "run_id")


def intervened_runs(approvals: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs for which an approval was asked, one row per run."""
    asked = approvals.select("run_id").distinct()
    return flt.not_dry(runs).join(asked, F.col("id") == F.col("run_id"), "left_semi")


def events_to_triggers(events: DataFrame, triggers: DataFrame, row_filter: Column | None = None) -> DataFrame:
    """Events matched to enabled event triggers of the same tenant and event type.

    ``row_filter`` is the trigger's own condition over both rows; null rejects.
    """
    t = triggers.where("enabled AND type = 'event'").select(
        F.col("id").alias("trigger_id"), F.col("tenant_id").alias("_t"), F.col("on_event").alias("_e"),
        *[c for c in triggers.columns if c not in ("id", "tenant_id", "on_event", "type", "enabled")],
    )
    j = events.join(in_lists(t, ["_t", "_e"]), (F.col("tenant_id") == F.col("_t")) & (F.col("type") == F.col("_e")))
    j = j.select(*events.columns, F.inline("_rows"))
    return j if row_filter is None else j.where(F.coalesce(row_filter, F.lit(False)))


LIST_ROWS = 1024  # rows that one list holds at most


def in_lists(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and, as ``_rows``, their rows in one or several short lists; ``inline`` gives the rows back.

    A row that meets many of the other side goes through the join once per list instead of once per pair.
    """
    rest = F.struct(*[c for c in df.columns if c not in keys])
    numbered = df.withColumn("_list", F.expr(f"(row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {keys[0]}) - 1) div {LIST_ROWS}"))
    return numbered.groupBy(*keys, "_list").agg(F.collect_list(rest).alias("_rows")).drop("_list")


def filter_by_text(column: str, texts: list[str]) -> Column:
    """Row filter from a column of condition texts, given the distinct texts in the configuration.

    Under ANSI rules a value on which a text fails stops the job; ``where_text_passes`` rejects the row instead.
    """
    out = F.when(F.col(column).isNull(), True)
    for t in texts:
        out = out.when(F.col(column) == t, flt.passes(t))
    return out.otherwise(False)


def where_text_passes(df: DataFrame, column: str, texts: list[str]) -> DataFrame:
    """Rows that pass the condition whose text they carry; none passes always.

    A row is rejected where its condition fails to evaluate on it, or is no condition on these columns at all.
    """

    def usable(text: str) -> bool:
        try:
            df.select(flt.passes(text)).schema  # noqa: B018
        except AnalysisException:  # also texts that do not parse
            return False
        return True

    with flt.errors_as_null(df.sparkSession):
        return df.where(filter_by_text(column, [t for t in texts if usable(t)]))


def completions_to_triggers(runs: DataFrame, triggers: DataFrame) -> DataFrame:
    """Finished runs matched to enabled completion triggers; the wanted outcome becomes part of the join key."""
    wanted = (
        F.when(F.col("want") == "any", F.array(*map(F.lit, model.FINISHED_RUN)))
        .when(F.col("want") == "failed", F.array(*map(F.lit, model.FAILED_RUN)))
        .otherwise(F.array(F.lit("succeeded")))
    )
    t = triggers.where("enabled AND type = 'completion'").select(
        F.col("id").alias("trigger_id"), "tenant_id", F.col("on_workflow").alias("workflow_name"), F.explode(wanted).alias("status")
    )
    done = runs.where(flt.is_finished(F.col("status"))).select(F.col("id").alias("run_id"), "tenant_id", "workflow_name", "status")
    keys = ["tenant_id", "workflow_name", "status"]
    return done.join(in_lists(t, keys), keys).select(*keys, "run_id", F.inline("_rows"))


def resume_waits(waits: DataFrame, events: DataFrame) -> DataFrame:
    """Waiting steps matched to the first event that resumes them.

    ``waits``: tenant_id, run_id, step_id, wait_event, wait_correlation.
    ``events``: tenant_id, type, correlation, seq.  A wait without a correlation
    takes any event of its type.  Events are first cut to one per key, so the
    join yields at most one row per wait however hot an event type is.
    """
    any_first = events.groupBy("tenant_id", F.col("type").alias("wait_event")).agg(F.min("seq").alias("seq"))
    by_corr = (
        events.where(F.col("correlation").isNotNull())
        .groupBy("tenant_id", F.col("type").alias("wait_event"), F.col("correlation").alias("wait_correlation"))
        .agg(F.min("seq").alias("seq"))
    )
    open_waits = waits.where(F.col("wait_correlation").isNull()).join(any_first, ["tenant_id", "wait_event"])
    keyed = waits.where(F.col("wait_correlation").isNotNull()).join(by_corr, ["tenant_id", "wait_event", "wait_correlation"])
    return open_waits.unionByName(keyed)


def events_to_hooks(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """One row per (hook, event): the hook's list becomes part of the join key."""
    h = hooks.select("hook_id", "tenant_id", F.explode(F.array_distinct("events")).alias("type")).distinct()
    keys = ["tenant_id", "type"]
    return events.join(in_lists(h, keys), keys).select(*keys, *[c for c in events.columns if c not in keys], F.inline("_rows"))


def nearest_names(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """Closest known name for each unknown one, within max(2, floor(len / 3)) edits.

    ``unknown(name)``, ``known(name, position)``.  Ties go to the earlier known
    name.  Instead of comparing everything with everything, short names meet on
    what is left of both after two deletions, longer ones on a piece unchanged.
    """
    near = name_candidates(unknown, known).withColumn("distance", F.levenshtein("ul", "kl")).where("distance <= d")
    best = near.groupBy("unknown").agg(F.min_by(F.struct("known", "distance"), F.struct("distance", "position")).alias("b"))
    return best.select("unknown", F.col("b.known").alias("suggestion"), F.col("b.distance").alias("distance"))


SHORT_NAME = 8  # up to this length two edits are allowed, whatever the name


def _after_deletions(text: str) -> str:
    """SQL for the strings left of a text after no, one or two deletions."""
    one = lambda t: f"transform(filter(sequence(0, length({t})), p -> p > 0), p -> concat(substr({t}, 1, p - 1), substr({t}, p + 1)))"
    once = f"array_distinct({one(text)})"
    return f"array_distinct(concat(array({text}), {once}, flatten(transform({once}, s -> {one('s')}))))"


def name_candidates(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of names that may be within reach: unknown, ul, d, known, kl, position.

    Two short names two edits apart have a string in common that is left of either after at most two
    deletions; names have at most 56 of these.  A longer known name is cut into (edits + 1) pieces: a
    name within reach must contain one piece unchanged and near its place, which is an equality join on
    (edits, length, piece no, piece).
    """
    u = unknown.select(F.col("name").alias("unknown")).distinct().withColumn("ul", F.lower("unknown"))
    u = u.withColumn("d", F.greatest(F.lit(2), F.floor(F.length("unknown") / 3)).cast("int"))
    k = known.groupBy(F.col("name").alias("known")).agg(F.min("position").alias("position"))
    k = k.withColumn("kl", F.lower("known")).withColumn("len", F.length(F.lower("known")))
    brief = u.where(F.length("ul") <= SHORT_NAME).where("d = 2")
    left = brief.withColumn("rest", F.explode(F.expr(_after_deletions("ul"))))
    right = k.where(F.col("len") <= SHORT_NAME + 2).select("known", "kl", "position", F.explode(F.expr(_after_deletions("kl"))).alias("rest"))
    short_pairs = left.join(right, "rest").select("unknown", "ul", "d", "known", "kl", "position")

    u = u.where((F.length("ul") > SHORT_NAME) | (F.col("d") > 2))
    reach = u.select("d", F.explode(F.expr("sequence(greatest(0, length(ul) - d), length(ul) + d)")).alias("len")).distinct()
    # piece i of a name of this length covers [i*len/(d+1), (i+1)*len/(d+1))
    pieces = k.join(reach, "len").select(
        "known", "position", "kl", "d", "len",
        F.explode(F.expr(
            "transform(sequence(0, d), i -> named_struct('i', i, 'piece', "
            "substring(kl, cast(i * len div (d + 1) as int) + 1, cast((i + 1) * len div (d + 1) - i * len div (d + 1) as int))))"
        )).alias("p"),
    ).select("known", "position", "kl", "d", "len", "p.i", "p.piece")
    probes = u.withColumn("len", F.explode(F.expr("sequence(greatest(0, length(ul) - d), length(ul) + d)")))
    probes = probes.withColumn("i", F.explode(F.expr("sequence(0, d)")))
    probes = probes.withColumn("at", F.expr("cast(i * len div (d + 1) as int)")).withColumn(
        "size", F.expr("cast((i + 1) * len div (d + 1) - i * len div (d + 1) as int)")
    )
    # piece i can only sit where the edits before it (at most i) and after it (at most d - i) allow
    lo = F.expr("greatest(0, at - i, at + length(ul) - len - (d - i))")
    hi = F.expr("least(at + i, at + length(ul) - len + (d - i), length(ul) - size)")
    probes = probes.withColumn("lo", lo).withColumn("hi", hi).where("hi >= lo").withColumn("s", F.explode(F.sequence("lo", "hi")))
    probes = probes.select("unknown", "ul", "d", "len", "i", F.expr("substring(ul, s + 1, size)").alias("piece")).distinct()
    pairs = probes.join(pieces, ["d", "len", "i", "piece"]).select("unknown", "ul", "d", "known", "kl", "position")
    return short_pairs.unionByName(pairs).distinct()


def dependency_states(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Each step of a run with the state of every step it depends on.

    ``steps``: run_id, plan_hash, step_id, status, handled.  Dependencies with no
    state row are left out, as an unknown dependency does not hold a step back.
    """
    mine = steps.select("run_id", "plan_hash", "step_id", F.col("status").alias("status"))
    dep = steps.select(
        "run_id", F.col("step_id").alias("depends_on"), F.col("status").alias("dep_status"), F.col("handled").alias("dep_handled")
    )
    e = edges.select("plan_hash", "step_id", "depends_on").distinct()
    return mine.join(e, ["plan_hash", "step_id"]).join(dep, ["run_id", "depends_on"])


def usage_against_limits(used: DataFrame, accounts: DataFrame, tenants: DataFrame) -> DataFrame:
    """Monthly usage, effective plan and what is left, for every tenant."""
    limits = F.create_map(*[F.lit(x) for kv in model.PLAN_LIMITS.items() for x in kv])
    t = tenants.select(F.col("id").alias("tenant_id"))
    j = t.join(accounts, "tenant_id", "left").join(used.select("tenant_id", "used"), "tenant_id", "left")
    j = j.withColumn("plan", flt.effective_plan(F.col("plan"), F.col("status")))
    j = j.withColumn("used", F.coalesce("used", F.lit(0))).withColumn("run_limit", F.element_at(limits, F.col("plan")))
    return j.select(
        "tenant_id", "plan", F.coalesce("status", F.lit("free")).alias("status"), "used", "run_limit",
        F.greatest(F.lit(0), F.col("run_limit") - F.col("used")).alias("remaining"),
    )


def child_runs(runs: DataFrame) -> DataFrame:
    """Runs joined to the runs they started."""
    child = runs.where(F.col("parent_run_id").isNotNull()).select(
        F.col("parent_run_id").alias("id"), F.col("id").alias("child_id"), F.col("status").alias("child_status")
    )
    return runs.select("tenant_id", "id", "status").join(child, "id")


def workflow_facts(settings: DataFrame, versions: DataFrame, plans: DataFrame, run_stats: DataFrame) -> DataFrame:
    """One row per workflow that has a stable version with a plan, with its run statistics."""
    s = settings.where(F.col("stable_version").isNotNull()).select(
        "tenant_id", F.col("name").alias("workflow_name"), "enabled", "killed", F.col("stable_version").alias("version")
    )
    v = versions.select("tenant_id", F.col("name").alias("workflow_name"), "version", "plan_hash", F.col("published_at").alias("active_since"))
    p = plans.select("tenant_id", "plan_hash").distinct()
    j = s.join(v, ["tenant_id", "workflow_name", "version"]).join(p, ["tenant_id", "plan_hash"], "left_semi")
    j = j.join(run_stats, ["tenant_id", "workflow_name"], "left")
    return j.fillna(0, ["total", "succeeded", "failed", "cancelled"]).fillna(0.0, ["cost"])
