"""What happened to a run, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import human_ms, ms_between
from tidemark.operators import filters as flt

# Headline of each status; {took} is the duration, {at} the waiting step, {step} the first failed one
HEADLINES = {
    "succeeded": "Succeeded{took}.",
    "cancelled": "Cancelled before it finished.",
    "queued": "Queued; it has not started yet.",
    "running": "Running.",
    "waiting-approval": "Paused, waiting for approval{at}.",
    "waiting-event": "Paused, waiting for an event{at}.",
    "rolled-back": "Failed at {step} and was rolled back.",
    "compensation-failed": "Failed at {step} and the rollback did not complete — needs attention.",
}
OTHER_HEADLINE = "Failed at {step}."


def _quoted(step: Column) -> Column:
    return F.concat(F.lit("“"), F.coalesce(step, F.lit("a step")), F.lit("”"))


def first_bad_step(steps: DataFrame) -> DataFrame:
    """The first failed step of each run, unhandled ones before handled ones, with undo counts.

    Steps go by completion, those without one after the others, then by their place in the plan where
    ``steps`` has it (``order``), then by the number in their id.
    """
    place = F.col("order") if "order" in steps.columns else F.lit(None).cast("int")
    number = F.regexp_extract("step_id", r"(\d+)$", 1).try_cast("bigint")
    order = F.struct(F.col("handled").isNotNull(), F.col("completed_seq").isNull(), F.col("completed_seq"), place, number, F.col("step_id"))
    failed = F.col("status") == "failed"
    return steps.groupBy("run_id").agg(
        F.min_by(F.when(failed, F.struct("step_id", "error")), F.when(failed, order)).alias("bad"),
        F.count_if(F.col("compensation_status") == "done").alias("undone"),
        F.count_if(F.col("compensation_status") == "failed").alias("undo_failed"),
        F.min(F.when(F.col("status").startswith("waiting"), F.col("step_id"))).alias("waiting_step"),
    )


def _filled(template: Column, **marks: Column) -> Column:
    """A template with its marks replaced, all at once, so that values may hold braces."""
    parts = F.split(template, r"[{}]")
    values = F.create_map(*[x for name, value in marks.items() for x in (F.lit(name), value)])
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.element_at(values, p))), "")


def explain_runs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Headline for every run; cause, effect and next step of a failed one, told from its own error and undo records."""
    j = runs.join(first_bad_step(steps), F.col("id") == F.col("run_id"), "left")
    took = human_ms(ms_between(F.col("started_at"), F.col("finished_at")))
    after = lambda word, text: F.coalesce(F.concat(F.lit(word), text), F.lit(""))
    waiting = F.when(F.col("waiting_step").isNotNull(), _quoted(F.col("waiting_step")))
    templates = F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv])
    template = F.coalesce(F.try_element_at(templates, F.coalesce("status", F.lit(""))), F.lit(OTHER_HEADLINE))
    headline = _filled(template, took=after(" in ", took), at=after(" at ", waiting), step=_quoted(F.col("bad.step_id")))
    failed = flt.is_failed(F.col("status"))
    err = F.coalesce(F.col("bad.error"), F.col("error"))
    code, kind = F.coalesce(err["code"], F.lit("UNKNOWN")), F.coalesce(err["class"], F.lit("unknown"))
    cause = F.concat(code, F.lit(" ("), kind, F.lit(")"), after(": ", err["message"]))
    undo = F.format_string("%d steps undone, %d not", F.coalesce("undone", F.lit(0)), F.coalesce("undo_failed", F.lit(0)))
    again = F.when(F.coalesce(err["retryable"], F.lit(False)), F.concat(code, F.lit(" is marked retryable: run it again"))).otherwise(
        F.concat(code, F.lit(" is not marked retryable: a second run needs another input, definition or environment")))
    left_over = F.when(F.col("undo_failed") > 0, F.format_string("; first clear up after %d steps", F.col("undo_failed"))).otherwise("")
    return j.select(
        "tenant_id", "id", headline.alias("headline"),
        F.when(failed, code).alias("code"),
        F.when(failed, kind).alias("error_class"),
        F.when(failed, cause).alias("cause"),
        F.when(failed, undo).alias("what_happened_next"),
        F.when(failed, F.concat(again, left_over)).alias("suggestion"),
    )
