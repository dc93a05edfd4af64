"""Ordered work over groups of any size.

A tenant may own a third of the history.  A plain ``Window.partitionBy(tenant)``
would send all of it through one task, so the helpers here cut every group into
bounded chunks, work inside the chunks in parallel, and carry only one summary
row per chunk across chunk borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP_N_SALTS = 64


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank", salts: int = TOP_N_SALTS
) -> DataFrame:
    """The first ``n`` rows of each group, exactly, in two steps.

    Each salt of a group keeps its own first ``n`` (Spark also cuts before the
    shuffle), so the last task of a hot group sees at most ``salts * n`` rows.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not _is_complex(df, c)]), F.lit(salts))
    salted = df.withColumn("_salt", salt)
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r", "_salt")
    last = W.partitionBy(*keys).orderBy(*order)
    return few.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= n)


def newest_per_group(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """The newest ``n`` rows of each group, for an ``n`` too large to be cut before the shuffle.

    Rows are first counted per group and hour, which shuffles next to nothing; the
    hour in which a group reaches ``n`` rows bounds what is then shuffled and ranked.
    """
    hour = F.date_trunc("hour", F.col(ts))
    counts = df.groupBy(*keys, hour.alias("_hour")).agg(F.count("*").alias("_c"))
    newer = W.partitionBy(*keys).orderBy(F.desc("_hour")).rowsBetween(W.unboundedPreceding, -1)
    wanted = counts.withColumn("_newer", F.coalesce(F.sum("_c").over(newer), F.lit(0))).where(F.col("_newer") < n)
    cut = wanted.groupBy(*keys).agg(F.min("_hour").alias("_cut"))
    cut = cut.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cut")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    kept = df.join(cut, same & (F.col(ts) >= F.col("_cut"))).select(*df.columns)
    return top_n_per_group(kept, keys, [F.desc(ts), F.desc(tie)], n, rank)


def _is_complex(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def with_chunk(df: DataFrame, order_col: str, rows_per_chunk: int) -> DataFrame:
    """``_chunk`` from a dense, growing sequence number: bounded rows, stable on retry."""
    return df.withColumn("_chunk", F.floor(F.col(order_col) / F.lit(rows_per_chunk)))


def _same_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their group; a null key is a key like any other."""
    renamed = groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    return rows.join(renamed, same).drop(*[f"_g{i}" for i in range(len(keys))])


def chunked_lag(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    columns: Mapping[str, str],
    rows_per_chunk: int = 1_000_000,
    index: str | None = None,
) -> DataFrame:
    """``lag(col) OVER (PARTITION BY keys ORDER BY order_col)`` for each ``col -> alias``.

    ``index`` also names a 1-based row number within the group.

    ``order_col`` is a global append sequence, so a chunk holds at most
    ``rows_per_chunk`` rows of all groups together.  Rows inside a chunk look one
    row back; the first row of a chunk takes the last row of the group's previous
    chunk from a table with one row per (group, chunk).
    """
    chunked = with_chunk(df, order_col, rows_per_chunk)
    last = F.max_by(F.struct(*[F.col(c) for c in columns]), F.col(order_col)).alias("_cl_last")
    tails = chunked.groupBy(*keys, "_chunk").agg(last, F.count("*").alias("_cl_rows"))
    across = W.partitionBy(*keys).orderBy("_chunk")
    earlier = F.sum("_cl_rows").over(across.rowsBetween(W.unboundedPreceding, -1))
    heads = tails.select(
        *keys, "_chunk", F.lag("_cl_last").over(across).alias("_cl_carry"), F.coalesce(earlier, F.lit(0)).alias("_cl_before")
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(order_col)
    rows = chunked.withColumn("_cl_at", F.row_number().over(inside)).withColumn("_cl_first", F.col("_cl_at") == 1)
    for col, alias in columns.items():
        rows = rows.withColumn(f"_cl_in_{alias}", F.lag(col).over(inside))
    out = _same_group(rows, heads, [*keys, "_chunk"])
    for col, alias in columns.items():
        out = out.withColumn(
            alias, F.when(F.col("_cl_first"), F.col(f"_cl_carry.{col}")).otherwise(F.col(f"_cl_in_{alias}"))
        ).drop(f"_cl_in_{alias}")
    if index:
        out = out.withColumn(index, F.col("_cl_before") + F.col("_cl_at"))
    return out.drop("_chunk", "_cl_first", "_cl_carry", "_cl_at", "_cl_before")


def chunked_running_sum(
    df: DataFrame, keys: Sequence[str], order_col: str, value: Column, alias: str, rows_per_chunk: int = 1_000_000
) -> DataFrame:
    """Running sum up to and including the row, cut into chunks like ``chunked_lag``."""
    chunked = with_chunk(df, order_col, rows_per_chunk).withColumn("_v", value)
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    rows = chunked.withColumn("_run", F.sum("_v").over(inside))
    rows = _same_group(rows, base, [*keys, "_chunk"])
    return rows.withColumn(alias, F.col("_run") + F.col("_base")).drop("_chunk", "_v", "_run", "_base")


def chunked_running(
    df: DataFrame, keys: Sequence[str], order_col: str, upto: Mapping[str, Column], before: Mapping[str, Column], rows_per_chunk: int = 1_000_000
) -> DataFrame:
    """The largest value of each column so far, up to the row (``upto``) or before it (``before``), all in one pass cut into chunks like ``chunked_lag``."""
    values = {**upto, **before}
    chunked = with_chunk(df, order_col, rows_per_chunk).withColumns({f"_v_{a}": c for a, c in values.items()})
    tails = chunked.groupBy(*keys, "_chunk").agg(*[F.max(f"_v_{a}").alias(f"_t_{a}") for a in values])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = tails.select(*keys, "_chunk", *[F.max(f"_t_{a}").over(earlier).alias(f"_b_{a}") for a in values])
    inside = W.partitionBy(*keys, "_chunk").orderBy(order_col)
    rows = chunked.withColumns({f"_r_{a}": F.max(f"_v_{a}").over(inside.rowsBetween(W.unboundedPreceding, 0 if a in upto else -1)) for a in values})
    rows = _same_group(rows, base, [*keys, "_chunk"])
    return rows.select(*df.columns, *[F.greatest(f"_r_{a}", f"_b_{a}").alias(a) for a in values])


def _bin(value: Column) -> Column:
    """A monotone bin with a bounded number of values: about eight significant bits."""
    v = F.greatest(value, F.lit(0)).cast("bigint")
    bits = F.length(F.bin(v))
    shift = F.greatest(bits - 8, F.lit(0))
    return shift * 256 + F.floor(v / F.pow(F.lit(2.0), shift))


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]
) -> DataFrame:
    """Exact order statistics of a non-negative whole-number column, one row per group.

    ``ranks`` maps an output name to a 1-based rank, an expression over ``n`` (the
    group's row count).  The rows are counted per (group, value) first, then a
    histogram of at most some ten thousand bins per group finds the bin that holds
    each rank, and only that bin's distinct values are ordered.  No task ever sees
    a whole group.  Groups without values are absent.
    """
    keys = list(keys)
    # the value is part of the shuffle key, so a hot group spreads; both uses below share this exchange
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    binned = counts.withColumn("_bin", _bin(F.col(value)))
    hist = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    hist = hist.withColumn("_upto", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(whole))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("bigint").alias("rank")) for k, v in ranks.items()]))
    picks = (
        hist.select(*keys, "_bin", "_upto", "_c", "n", wanted.alias("_w"))
        .where("_w.rank <= _upto AND _w.rank > _upto - _c")
        .select(*keys, "_bin", "n", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_upto") + F.col("_c")).alias("_at"))
    )
    inside = W.partitionBy(*keys, "_name").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    # null-safe: a null group key is a group, and both uses of ``counts`` stay the same plan, so its exchange is reused
    picks = picks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_pick"), "n", "_name", "_at")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_bin").eqNullSafe(F.col("_pick")))
    hits = (
        binned.join(picks, same)
        .withColumn("_run", F.sum("_c").over(inside))
        .where("_run >= _at AND _run - _c < _at")
    )
    aggs = [F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in ranks]
    return hits.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def first_at_or_after(
    askers: DataFrame, events: DataFrame, keys: Sequence[str], ask_ms: str, event_ms: str, payload: Sequence[str], bucket_ms: int = 3_600_000
) -> DataFrame:
    """Each asker with the first event of its key at or after its time, or nulls.

    Time is cut into buckets.  Inside a bucket a running window looks ahead; an
    asker with no later event in its bucket takes the head of the next bucket that
    has one.  Nothing pairs askers with events, so a hot key stays linear.
    """
    hit = F.struct(F.col(event_ms).alias("ms"), *[F.col(c) for c in payload])
    e = events.select(*keys, F.col(event_ms).alias("_ms"), F.lit(1).alias("_kind"), hit.alias("_hit"), F.lit(None).cast(askers.schema).alias("_row"))
    null_hit = F.lit(None).cast(e.schema["_hit"].dataType)
    a = askers.select(*keys, F.col(ask_ms).alias("_ms"), F.lit(0).alias("_kind"), null_hit.alias("_hit"), F.struct(*askers.columns).alias("_row"))
    u = a.unionByName(e).withColumn("_bucket", F.floor(F.col("_ms") / bucket_ms))
    # latest first, events before askers of the same moment: the last event so far is the next one in time
    back = W.partitionBy(*keys, "_bucket").orderBy(F.desc("_ms"), F.desc("_kind"), F.desc("_hit")).rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("_near", F.last("_hit", ignorenulls=True).over(back))
    heads = u.groupBy(*keys, "_bucket").agg(F.min("_hit").alias("_head"))
    later = W.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*keys, "_bucket", F.last("_head", ignorenulls=True).over(later).alias("_next"))
    j = _same_group(u.where("_kind = 0"), heads, [*keys, "_bucket"]).withColumn("_hit", F.coalesce("_near", "_next"))
    return j.select("_row.*", F.col("_hit.ms").alias(event_ms), *[F.col(f"_hit.{c}").alias(c) for c in payload])


def spaced_firsts(df: DataFrame, keys: Sequence[str], at: str, span: int) -> DataFrame:
    """The distinct moments ``keys, at`` of each key that open a new span: the first, then always the first more than ``span`` after the last one.

    ``at`` is a whole number.  Each moment points at the next that would follow it; the chain from the first moment is then
    walked by pointer doubling, so a key of any length takes as many rounds as its chain has binary digits, each a join by moment.
    """
    keys = list(keys)
    moments = df.select(*keys, at).distinct()
    asked = moments.withColumn("_due", F.col(at) + F.lit(span) + 1)
    events = moments.withColumnRenamed(at, "_next")
    jump = first_at_or_after(asked, events, keys, "_due", "_next", [], bucket_ms=max(1, span // 16)).where("_next IS NOT NULL")
    return walked(moments.groupBy(*keys).agg(F.min(at).alias(at)), jump, keys, at)


def walked(starts: DataFrame, jump: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All ``keys, at`` reached from ``starts`` by following ``jump(keys, at, _next)``, which leads forward only.

    Pointer doubling: every round doubles the length of a jump, and what was reached jumps on.
    """
    from tidemark.session import cut_lineage

    keys = list(keys)
    jump = cut_lineage(jump.select(*keys, at, "_next"), "jumps")
    found = cut_lineage(starts.select(*keys, at), "firsts")
    n = found.count()
    while not jump.isEmpty():
        onward = _same_group(found, jump, [*keys, at]).select(*keys, F.col("_next").alias(at))
        found = cut_lineage(found.unionByName(onward).distinct(), "firsts")
        now = found.count()
        if now == n:
            break
        n = now
        after = jump.select(*keys, F.col(at).alias("_next"), F.col("_next").alias("_then"))
        jump = cut_lineage(_same_group(jump, after, [*keys, "_next"]).select(*keys, at, F.col("_then").alias("_next")), "jumps")
    return found
