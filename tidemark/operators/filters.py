"""Row filters, predicates and row-level verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model


def not_dry(df: DataFrame) -> DataFrame:
    """Dry runs simulate effects, so analytics leaves them out."""
    return df.where(~F.col("dry_run"))


def is_failed(status: Column) -> Column:
    return status.isin(*model.FAILED_RUN)


def is_finished(status: Column) -> Column:
    return status.isin(*model.FINISHED_RUN)


def is_terminal(status: Column) -> Column:
    return status.isin(*model.TERMINAL_RUN)


def is_active(status: Column) -> Column:
    return status.isin(*model.ACTIVE_RUN)


def of_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def trailing(df: DataFrame, as_of: Column, days: float, column: str = "created_at") -> DataFrame:
    """Rows at or after ``as_of`` minus the window; later rows stay in, as in the source system."""
    seconds = int(days * 86_400)
    return df.where(F.col(column) >= as_of - F.expr(f"make_dt_interval(0, 0, 0, {seconds})"))


def scheduled_for(payload: str = "trigger_payload") -> Column:
    """The planned time of a scheduled run; null for every other trigger."""
    text = F.get_json_object(F.col(payload), "$.scheduledFor")
    return F.when(F.col("trigger_type") == "schedule", F.try_to_timestamp(text))


def read_path(json: Column, *path: str | int) -> Column:
    """Nested read that never raises: a missing step anywhere gives null."""
    spot = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(json, spot)


def wildcard_match(text: Column, pattern: str) -> Column:
    """Case-blind search in which ``*`` stands for anything; the rest is literal."""
    escaped = pattern.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return F.lower(text).like(f"%{escaped}%")


def search_workflows(
    df: DataFrame, text: str = "", state: str | None = None, criticality: str | None = None, last_status: str | None = None
) -> DataFrame:
    """Workflow list filters; text is sought in name, description and owner together."""
    names = [c for c in ("name", "description", "owner") if c in df.columns]
    hay = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in names])
    shown = F.when(F.col("killed"), "killed").when(F.col("enabled"), "enabled").otherwise("disabled")
    out = df.withColumn("state", shown).where(wildcard_match(hay, text))
    if state:
        out = out.where(F.col("state") == state)
    if criticality:
        out = out.where(F.col("criticality") == criticality)
    if last_status:
        out = out.where(F.col("last_status") == last_status)
    return out


def passes(predicate: str | None) -> Column:
    """A user's row filter in Spark SQL: absent passes, null rejects.

    Under ANSI rules an evaluation error stops the job; ``where_passes`` turns errors into null instead.
    """
    return F.lit(True) if not predicate else F.coalesce(F.expr(predicate).cast("boolean"), F.lit(False))


@contextmanager
def errors_as_null(spark: SparkSession):
    """Expressions made and resolved inside give null where a cast, division or access fails.

    The session's rule is restored at the end; frames built inside keep what they were built with.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def where_passes(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows that pass a user's filter; a row on which it fails to evaluate is rejected, not the job."""
    with errors_as_null(df.sparkSession):
        return df.where(passes(predicate))


def with_first_violation(df: DataFrame, invariants: Mapping[str, str], name: str = "violated") -> DataFrame:
    """Adds ``first_violation``; an invariant that fails to evaluate counts as broken."""
    with errors_as_null(df.sparkSession):
        return df.withColumn(name, first_violation(invariants))


def expect(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """Evaluate aggregate conditions over the whole input; one row per check."""
    one = df.agg(*[F.coalesce(F.expr(c).cast("boolean"), F.lit(False)).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("passed")) for n in checks])
    return one.select(F.inline(pairs))


def assert_all(df: DataFrame, checks: Mapping[str, str], message: str = "Assertion failed") -> DataFrame:
    """Like ``expect``, but the job fails with the first broken check's name."""
    bad = F.raise_error(F.concat(F.lit(f"{message}: "), F.col("check"))).cast("boolean")
    return expect(df, checks).withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(bad))


def mask_inputs(inputs: Column, sensitivity: Column, mask: str = "[REDACTED]") -> Column:
    """Hide confidential and secret members of a string map, given name -> sensitivity."""
    hide = lambda k, v: F.when(F.try_element_at(sensitivity, k).isin("confidential", "secret"), F.lit(mask)).otherwise(v)
    return F.transform_values(inputs, hide)


def first_violation(invariants: Mapping[str, str]) -> Column:
    """Name of the first invariant that is not true; an expression that gives null counts as broken."""
    out = None
    for name, text in invariants.items():
        broken = ~F.coalesce(F.expr(text).cast("boolean"), F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return F.lit(None).cast("string") if out is None else out


def first_match(cases: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Ordered cases: the first true one names the branch; none and no default is an error code."""
    out = None
    for name, text in cases:
        hit = F.coalesce(F.expr(text).cast("boolean"), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    fallback = F.lit(default if default is not None else "BRANCH_NO_MATCH")
    return fallback if out is None else out.otherwise(fallback)


def due(df: DataFrame, at: str, as_of: Column, condition: Column, limit: int | None = None, tie: str = "id") -> DataFrame:
    """Rows whose time has come, earliest first."""
    out = df.where(condition & F.col(at).isNotNull() & (F.col(at) <= as_of)).orderBy(at, tie)
    return out if limit is None else out.limit(limit)


def due_steps(steps: DataFrame, runs: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Timers that have elapsed on steps of runs that are still open."""
    open_runs = runs.where(F.col("status").isin("running", "waiting-event", "waiting-approval")).select(
        F.col("id").alias("run_id"), "tenant_id"
    )
    waiting = F.col("status").isin("retry-wait", "waiting-timer", "waiting-event") & (F.col("wake_at") <= as_of)
    out = steps.where(waiting).join(open_runs, "run_id").orderBy("wake_at", "run_id", "step_id")
    return out if limit is None else out.limit(limit)


def retry_verdict(attempt: Column, max_attempts: Column, error_class: Column, retryable: Column, retry_on: Column) -> Column:
    """``struct(retry, reason)``; a null ``max_attempts`` means there is no policy."""
    def out(retry: bool, reason) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(retry).alias("retry"), text.alias("reason"))

    never = ("authorisation", "business", "catastrophic")
    return (
        F.when(max_attempts.isNull(), out(False, "no retry policy"))
        .when(attempt >= max_attempts, out(False, "attempts exhausted"))
        .when(error_class.isin(*never), out(False, F.concat(error_class, F.lit(" failures are not retried"))))
        .when((error_class == "contract") & (attempt < 2), out(True, "contract failures get one retry"))
        .when(error_class == "contract", out(False, "contract failure repeated"))
        .when(~retryable, out(False, "error is not retryable"))
        .when(
            ~F.array_contains(retry_on, error_class),
            out(False, F.concat(F.lit("'"), error_class, F.lit("' is not in retryOn"))),
        )
        .otherwise(out(True, "retryable"))
    )


def backoff_ms(attempt: Column, initial: Column, maximum: Column, jitter: Column, random: Column, fixed: Column | None = None) -> Column:
    """Delay before the next attempt; ``random`` in [0, 1) is supplied, never drawn."""
    grown = initial * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1))
    base = grown if fixed is None else F.when(fixed, initial.cast("double")).otherwise(grown)
    jittered = F.least(base, maximum) * (1 + jitter * (2 * random - 1))
    return F.greatest(F.lit(0), F.least(F.floor(jittered + 0.5), maximum)).cast("bigint")


def delivery_backoff_ms(attempts: Column, cap_ms: int = 3_600_000) -> Column:
    """Delay of an outgoing delivery after ``attempts`` failures."""
    return F.least(F.pow(F.lit(2.0), attempts) * 5_000, F.lit(cap_ms)).cast("bigint")


def outbox_kind(event_type: Column) -> Column:
    """Terminal outcomes are usage, governance decisions are audit, the rest is not mirrored."""
    return F.when(event_type.isin(*model.USAGE_EVENTS), "usage").when(event_type.isin(*model.AUDIT_EVENTS), "audit")


def effective_plan(plan: Column, status: Column) -> Column:
    """A paid plan counts only while its subscription is active or trialing."""
    paid = status.isin("active", "trialing") & plan.isin(*model.PAID_PLANS)
    return F.when(paid, plan).otherwise(F.lit("free"))
