"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in an order shuffled by a hash of its id, gets a *virtual finish
time*: the source's words up to the middle of the document divided by the source's target.  All
sources reach their targets together, so reading documents by ascending finish time serves each
source in proportion to its target at any moment; the reading is truncated where the total budget
is used up.  A second copy of a source queues behind the first, so repeats begin only where a
source is exhausted.  Since a source is served in its own order, the outcome is one cut point for
each source, and documents are taken by comparing themselves with it: texts are never shuffled.

Running sums never order a whole source in one task: documents fall into slots of the hash (and
then of the finish time), one sum per slot is carried over the slots, whose number is bounded, and
only the documents of one slot are ordered together.

Defined cases: a null text has size 0 and is never read; a source without words gets target 0;
null is a source of its own, last in the cycle of weights; rows that repeat an id and text are
read or left together; a document of any length is read whole or not at all; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
SLOT_ROWS = 2_000  # documents that share a slot on average, while there are fewer than MOST_SLOTS slots
MOST_SLOTS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(words).cast("long")


def shuffle_order(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The place of a document in its source: a hash of the id, then of the text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("/mix"))), F.md5(F.coalesce(text, F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size, …)`` with ``target`` and ``budget``: the budget shared by weight, no target above ``most`` times its size.

    Water filling: sources are taken by ascending capacity per weight; a source is full while its
    capacity per weight is within what the remaining budget gives a unit of the remaining weight.
    One row per source, so the ordering is small.
    """
    one = Window.partitionBy(F.lit(1))
    place = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    before = one.orderBy("__ratio", "__place").rowsBetween(Window.unboundedPreceding, -1)
    s = (
        sizes.withColumns({"__place": place, "__w": w, "__cap": F.col("source_size") * F.lit(float(most))})
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("budget", F.sum("source_size").over(one) * F.lit(share))
        .withColumn("__left", F.col("budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__w_left", F.sum("__w").over(one) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
        .withColumn("__full", F.col("__ratio") * F.col("__w_left") <= F.col("__left"))
    )
    # once a source is not full, none after it is: its level holds for all of them
    level = F.min(F.when(~F.col("__full"), F.struct("__ratio", "__place", (F.col("__left") / F.col("__w_left")).alias("level")))).over(one)["level"]
    s = s.withColumn("__level", level)
    return s.select(*sizes.columns, F.least(F.col("__cap"), F.coalesce(F.col("__w") * F.col("__level"), F.col("__cap"))).alias("target"), "budget")


def _running(df: DataFrame, keys: list[str], slot: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows up to each one, in the order (slot, order) within keys."""
    over = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    base = df.groupBy(*keys, slot).agg(F.sum(value).alias("__sum"))
    base = base.select(*(F.col(k).alias(f"__b{i}") for i, k in enumerate([*keys, slot])), (F.sum("__sum").over(over) - F.col("__sum")).alias("__base"))
    match = F.lit(True)
    for i, k in enumerate([*keys, slot]):
        match = match & F.col(k).eqNullSafe(F.col(f"__b{i}"))
    inside = F.sum(value).over(Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, inside).join(base, match).withColumn(name, F.col(name) + F.col("__base")).drop("__base", *(f"__b{i}" for i in range(len(keys) + 1)))


def _slots(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_SLOTS), F.ceil(rows / SLOT_ROWS)))


def cut_points(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source of ``sized(source, size, __h, __t)``: ``source_size``, ``target`` and ``cut``, the last place that is read."""
    one = Window.partitionBy(F.lit(1))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows")), weights, share, most)
    sources = sources.withColumns({"__slots": _slots(F.col("__rows")), "__all": _slots(F.sum("__rows").over(one))}).withColumnRenamed("source", "__source")
    queue = sized.where(F.col("size") > 0).join(sources, F.col("source").eqNullSafe(F.col("__source")))
    queue = queue.withColumn("__slot", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") / F.lit(2.0**32) * F.col("__slots")))
    queue = _running(queue.select("source", "size", "__h", "__t", "source_size", "target", "budget", "__all", "__slot"), ["source"], "__slot", ["__h", "__t"], "size", "__end")
    copies = queue.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("__finish", (F.col("__end") + F.col("__copy") * F.col("source_size") - F.col("size") / 2) / F.col("target"))
    copies = copies.withColumn("__time", F.floor(F.least(F.col("__finish"), F.lit(2.0)) * F.col("__all")))
    read = _running(copies.select("source", "size", "__h", "__t", "__copy", "__finish", "__time", "budget"), [], "__time", ["__finish", "source", "__copy", "__h", "__t"], "size", "__total")
    cut = read.where(F.col("__total") - F.col("size") / 2 <= F.col("budget")).groupBy(F.col("source").alias("__s")).agg(F.max(F.struct("__copy", "__h", "__t")).alias("cut"))
    return sources.join(cut, F.col("__source").eqNullSafe(F.col("__s")), "left").select(F.col("__source"), "source_size", "target", "cut")


def _with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows ``(source, __h, __t, …)`` with the figures of their source and ``__copies``, how often each is read."""
    last = (F.struct(F.col("__h"), F.col("__t")) <= F.struct(F.col("cut.__h"), F.col("cut.__t"))).cast("int")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    return joined.withColumn("__copies", F.when(F.col("cut").isNull() | (F.col("size") == 0), F.lit(0)).otherwise(F.col("cut.__copy") + last)).drop("cut")


def _sized(docs: DataFrame) -> DataFrame:
    h, t = shuffle_order(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("__h"), t.alias("__t"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs(doc_id, text, source)``: each row with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    The sizes are written once to the shared folder, so texts are read a single time.
    """
    sized = cut_lineage(_sized(docs), "mix-sizes")
    out = _with_copies(sized, cut_points(sized, weights, share, most))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("__copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is read."""
    columns = [f"`{c}`" for c in docs.columns]
    sized = cut_lineage(_sized(docs), "mix-sizes")
    h, t = shuffle_order(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*columns).alias("__row"), F.col("source"), word_count(F.col("text")).alias("size"), h.alias("__h"), t.alias("__t"))
    out = _with_copies(rows, cut_points(sized, weights, share, most)).where(F.col("__copies") > 0)
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
