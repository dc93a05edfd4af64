"""Rounding, ratios and the display forms shared by reports and findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity (Spark's ``round`` moves halves away from zero)."""
    scale = 10.0**digits
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 when there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def pct_text(rate: Column) -> Column:
    return F.concat(half_up(rate * 100).cast("bigint").cast("string"), F.lit("%"))


def _tenths(x: Column, unit: str) -> Column:
    n = F.floor(x * 10 + 0.5).cast("bigint")
    return F.concat((F.floor(n / 10)).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(unit))


def human_ms(ms: Column) -> Column:
    """``850ms``, ``1.5s``, ``3.0min``, ``2.0h``."""
    return (
        F.when(ms < 1000, F.concat(half_up(ms).cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60_000, _tenths(ms / 1000, "s"))
        .when(ms < 3_600_000, _tenths(ms / 60_000, "min"))
        .otherwise(_tenths(ms / 3_600_000, "h"))
    )


def ms_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def iso(ts: Column) -> Column:
    """ISO-8601 text with milliseconds, in UTC when the session is."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def nearest_rank(p: float) -> Column:
    """1-based nearest rank over a group of ``n`` rows."""
    n = F.col("n")
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(p / 100) * n)))


def upper_median() -> Column:
    return F.floor(F.col("n") / 2) + 1
