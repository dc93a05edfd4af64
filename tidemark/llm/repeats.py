"""Finding every repeated window of a fixed length in a corpus, exactly and without pairing places.

A *unit* is a run of neighbouring windows of one text that share an anchor.  The anchor is chosen
by the content of a window alone, so equal windows anywhere lie in units of equal keys.

1. Units are counted by (key, content of all their windows).  A content seen twice makes all its
   windows repeated; a key of one unit only has none; what is left are keys with different
   contents, which occur at the ends of repeats.
2. Of each such content one unit speaks for all.  Its windows are compared with those of the other
   contents of its key, by the caller's method, and the answer goes back to all its units.

Counts are partial sums, so a passage that a third of all texts share does not gather anywhere;
joins are by hash keys that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_buffer
from tidemark.session import cut_lineage

NO_ID = -(1 << 63)
KEYS = ["u", "hull"]
ROW = ["doc_id", "k"]


class Units(NamedTuple):
    text: np.ndarray  # number of the text in the batch
    u: np.ndarray  # key, int64
    hull: np.ndarray  # content of all windows, int64
    first: np.ndarray  # first window start
    last: np.ndarray  # last window start


UnitsOf = Callable[[np.ndarray, np.ndarray], Units]


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with the key of their rows; a null id counts as the smallest, a null text as empty."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("k"), "text")


def _concat(parts: list[Units]) -> Units:
    return Units(*(np.concatenate(x) for x in zip(*parts))) if parts else Units(*(np.zeros(0, np.int64) for _ in range(5)))


def units_of_batch(column: pa.Array, units_of: UnitsOf) -> Units:
    buf, offsets = text_buffer(column)
    parts = []
    for i, j in slices(offsets):
        u = units_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(u._replace(text=u.text + i))
    return _concat(parts)


def repeated_windows(docs: DataFrame, units_of: UnitsOf, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``doc_id, k, ranges`` (array of first and last start) of the repeated windows of ``docs``, for texts that have any.

    ``resolve(docs, speakers)`` gets ``speakers(u, hull, hulls, doc_id, k, first, last)`` and returns
    ``u, hull, a, b``: runs of repeated windows, counted from the unit's first one.
    """
    texts = keyed(docs)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units_of_batch(batch.column(0), units_of)
            yield pa.RecordBatch.from_arrays([pa.array(x.u), pa.array(x.hull)], KEYS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units_of_batch(batch.column(2), units_of)
            at = pa.array(x.text)
            columns = [pa.array(x.u), pa.array(x.hull), batch.column(0).take(at), batch.column(1).take(at), pa.array(x.first), pa.array(x.last)]
            yield pa.RecordBatch.from_arrays(columns, [*KEYS, *ROW, "first", "last"])

    counts = texts.select("text").mapInArrow(keys, "u long, hull long").groupBy(*KEYS).agg(F.count("*").alias("n"))
    total = counts.groupBy("u").agg(F.sum("n").alias("t"), F.count("*").alias("hulls")).where("t > 1").select("u", "hulls")
    status = cut_lineage(counts.join(total, "u"), "unit-counts")
    all_places = texts.select(*ROW, "text").mapInArrow(places, "u long, hull long, doc_id long, k long, first long, last long")
    found = cut_lineage(all_places.join(status, KEYS), "units")
    certain = found.where("n > 1").select(*ROW, F.col("first").alias("a"), F.col("last").alias("b"))
    mixed = found.where("hulls > 1")
    speaker = F.min(F.struct(*ROW, "first", "last")).alias("s")
    speakers = cut_lineage(mixed.groupBy(*KEYS, "hulls").agg(speaker).select(*KEYS, "hulls", "s.*"), "speakers")
    answers = cut_lineage(resolve(texts, speakers), "answers")
    uncertain = mixed.where("n = 1").join(answers, KEYS).select(*ROW, (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    return certain.union(uncertain).groupBy(*ROW).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def with_speakers(texts: DataFrame, speakers: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(text_bytes, u, hull, first, last, base)`` for each text that has speakers, with arrays of their columns; yields Arrow batches.

    ``base`` (0 if absent) is what ``first`` lies behind the first window of the unit.
    """
    base = F.col("base") if "base" in speakers.columns else F.lit(0).cast("long").alias("base")
    by_text = speakers.groupBy(*ROW).agg(F.collect_list(F.struct(*KEYS, "first", "last", base)).alias("units"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units = batch.column(1).slice(i, 1).flatten()
                buf, _ = text_buffer(batch.column(0).slice(i, 1))
                yield from run(buf, *(units.field(f).to_numpy() for f in (*KEYS, "first", "last", "base")))

    return texts.join(by_text, ROW).select("text", "units").mapInArrow(each, schema)


def repeated_hashes(windows: DataFrame) -> DataFrame:
    """``windows(u, hull, at, h)`` of speakers: runs ``u, hull, a, b`` of windows whose hash two different contents share.

    Equal windows have equal keys, so contents differ in ``hull``.
    """
    shared = windows.groupBy("h").agg(F.min("hull").alias("lo"), F.max("hull").alias("hi")).where("lo <> hi").select("h")
    at = windows.join(shared, "h", "left_semi").groupBy(*KEYS).agg(F.array_sort(F.collect_set("at")).alias("ats"))
    # a run begins where the place minus its rank changes
    ranked = at.select(*KEYS, F.posexplode("ats").alias("rank", "at")).groupBy(*KEYS, (F.col("at") - F.col("rank")).alias("run")).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return ranked.select(*KEYS, "a", "b")


def covered(ranges: list[dict] | None, n: int, length: int) -> np.ndarray:
    """Which of ``n`` places lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        edge[r["a"]] += 1
        edge[min(n, r["b"] + length)] -= 1
    return np.cumsum(edge[:n]) > 0


def digest(docs: DataFrame, ranges: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(text, ranges)`` for every row of ``docs``; returns ``doc_id`` and the columns of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]
    ranges = ranges.select(F.col("doc_id").alias("__d"), F.col("k").alias("__k"), "ranges")
    rows = keyed(docs).join(ranges, (F.col("doc_id") == F.col("__d")) & (F.col("k") == F.col("__k")), "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [run((t or "").encode(), r) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c)) for c in zip(*out))], ["doc_id", *names])

    rows = rows.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "ranges")
    return rows.mapInArrow(each, f"doc_id long, {schema}")
