"""Cron slots as a table function, for lateral joins."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of months and week days
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()


def _field(text: str, lo: int, hi: int, names: list[str] = []) -> frozenset[int]:
    """Allowed values of one field: lists, ranges, steps and names."""
    def num(s: str) -> int:
        s = s.lower()
        return names.index(s) + (lo if names is MONTHS else 0) if s in names else int(s)

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = lo, hi
        elif "-" in span:
            a, b = map(num, span.split("-", 1))
        else:
            a = num(span)
            b = hi if step else a
        if not (lo <= a <= b <= hi) or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(a, b + 1, int(step or 1)))
    return frozenset(out)


def parse(cron: str) -> tuple[frozenset[int], ...]:
    """Minutes, hours, days, months, week days (0 is Sunday) and whether both day fields are limited."""
    m, h, d, mo, wd = cron.split()
    week = frozenset(x % 7 for x in _field(wd, 0, 7, DAYS))
    return _field(m, 0, 59), _field(h, 0, 23), _field(d, 1, 31), _field(mo, 1, 12, MONTHS), week, d[0] not in "*?" and wd[0] not in "*?"


def slots(cron: str, zone: str | None, start: datetime, end: datetime):
    """UTC slots in (start, end].  A wall time skipped by a clock change fires right after it, a repeated one fires once."""
    minutes, hours, days, months, week, either = parse(cron)
    tz = ZoneInfo(zone) if zone else timezone.utc
    day = start.astimezone(tz).date()
    last = end.astimezone(tz).date()
    while day <= last:
        in_month, in_week = day.day in days, (day.weekday() + 1) % 7 in week
        if day.month in months and ((in_month or in_week) if either else (in_month and in_week)):
            seen = None
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = datetime(day.year, day.month, day.day, h, m, tzinfo=tz).astimezone(timezone.utc)
                    if start < at <= end and at != seen:
                        seen = at
                        yield at
        day += timedelta(days=1)


class CronSlots:
    """Table function ``cron_slots(cron, zone, from, to)`` giving one row per slot; times are UTC text."""

    def eval(self, cron: str, zone: str | None, start: str, end: str):
        if None in (cron, start, end):
            return
        at = lambda s: datetime.fromisoformat(s).replace(tzinfo=timezone.utc)
        for slot in slots(cron, zone, at(start), at(end)):
            yield (slot.replace(tzinfo=None).isoformat(sep=" "),)


def register(spark: SparkSession) -> None:
    spark.udtf.register("cron_slots", F.udtf(CronSlots, returnType="slot_text string"))


def expected_slots(schedules: DataFrame) -> DataFrame:
    """Every slot of every schedule (trigger_id, cron, zone, from_ts, to_ts) in its range."""
    spark = schedules.sparkSession
    register(spark)
    # passed as text, so the worker's own zone plays no part
    text = lambda c: f"date_format(s.{c}, 'yyyy-MM-dd HH:mm:ss')"
    q = f"SELECT s.*, to_timestamp(c.slot_text) AS slot FROM {{sched}} s, LATERAL cron_slots(s.cron, s.zone, {text('from_ts')}, {text('to_ts')}) c"
    return spark.sql(q, sched=schedules)


def classify_slots(slots_: DataFrame, fires: DataFrame, late_ms: int = 60_000) -> DataFrame:
    """Expected slots against the ticks that handled them: fired, rejected (missed and catch-up is none) or never seen.

    ``fires``: trigger_id, slot, handled_at.  ``slots_`` carries ``catchup``.  Only
    one handling per slot counts.
    """
    once = fires.groupBy("trigger_id", "slot").agg(F.min("handled_at").alias("handled_at"))
    j = slots_.join(once, ["trigger_id", "slot"], "left")
    late = F.unix_millis("handled_at") - F.unix_millis("slot")
    verdict = F.when(F.col("handled_at").isNull(), "missed").when((late > late_ms) & (F.coalesce("catchup", F.lit("none")) == "none"), "rejected").otherwise("fired")
    return j.withColumn("late_ms", late).withColumn("verdict", verdict)
