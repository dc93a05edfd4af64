"""How far sources of one language differ in their vocabulary, with late string materialization.

1. Tasks cut texts into terms and count them per (language, source) under 64-bit digests; only these
   fixed-width digests are shuffled.  Beside them, unshuffled, they write the smallest and largest
   string of each digest that they have met.
2. Digests in enough documents are kept.  Their smallest and largest strings are brought together: if
   they differ, several terms share the digest, and it is split: its terms are counted again under
   (digest, number among its strings).  A term that reaches the limit always lies under a digest that
   does, so nothing is lost before the split.
3. Rates and differences are integers.  Terms are ranked within a group by value alone, ties with the
   last rank included, and only what is left is joined with its text for the final order.
4. Two sources are compared term by term in numpy, over tiles of sources; tasks hand on one sum per
   pair, never one row per pair and term.

Defined cases: null text, language and source count as empty; an empty table gives no rows; a language
without kept terms has pairs of value 0; repeated rows count as documents of their own.  Groups
(language, source) are listed on the driver, 100 bytes each: the result holds the square of their
number, which bounds it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_buffer, words
from tidemark.session import cut_lineage

SLICE = 16 << 20  # bytes of text counted together
KNOWN = 2_000_000  # digests that are sent to every task at most; more are joined by shuffle
COMPARED = 1 << 16  # places gathered, or compared with the first of their digest, at a time
HANDED = 1 << 17  # rows handed on at a time
TILE = 256  # sources compared with all others at a time
CELLS = 1 << 21  # numbers in one comparison

_TERM = np.full(256, 32, np.uint8)  # bytes of terms, folded; a blank for all others
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)

COUNTS = "lang int, g int, digest long, n_docs long, n long, low string, high string"
SPLIT = "lang int, g int, digest long, term string, n_docs long, n long"
TERM = ["digest", "part"]


class Groups:
    """The groups (language, source) of a corpus in order, and their numbers."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = sorted(pairs)
        self.number = {p: i for i, p in enumerate(self.pairs)}
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in self.pairs))}
        self.lang = np.array([langs[lang] for lang, _ in self.pairs], np.int32)
        self.first = np.searchsorted(self.lang, np.arange(len(langs)))  # number of each language's first group
        self.size = np.bincount(self.lang, minlength=len(langs))

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        return np.fromiter((self.number[p] for p in pairs), np.int64, batch.num_rows)


def _terms(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, digest and text of each term."""
    narrow = np.int32 if len(buf) < 1 << 31 else np.int64
    parts = []
    for i, j in slices(offsets):
        starts, ends, hashes, first = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        text = np.repeat(np.arange(i, j, dtype=narrow), np.diff(first))
        parts.append(((starts + offsets[i]).astype(narrow), (ends + offsets[i]).astype(narrow), (hashes >> np.uint64(64 - bits)).view(np.int64), text))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of runs in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def _gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given places one after another, and where each begins."""
    at = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    out = np.empty(at[-1], np.uint8)
    for lo in range(0, len(starts), COMPARED):
        part = at[lo : lo + COMPARED + 1]
        out[part[0] : part[-1]] = buf[np.repeat(starts[lo : lo + COMPARED] - part[:-1], np.diff(part)) + np.arange(part[0], part[-1])]
    return out, at


def _numbered(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order, the first place of each, and the number among them of each place."""
    order = np.argsort(digest, kind="stable")
    ranked = digest[order]
    head = _runs(ranked)
    number = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    number[order] = np.repeat(np.arange(len(head), dtype=number.dtype), np.diff(np.append(head, len(order))))
    return ranked[head], order[head], number


def _sums(group: np.ndarray, text: np.ndarray, number: np.ndarray, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group and digest number of each cell, its texts and its places."""
    spot = text.astype(np.int64)
    spot *= ids
    spot += number
    spot.sort()
    run_at = _runs(spot)
    n, spot = np.diff(np.append(run_at, len(spot))), spot[run_at]
    del run_at
    cell = group[spot // ids] * ids
    spot %= ids
    cell += spot
    del spot
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    del order
    run_at = _runs(cell)
    docs, n = np.diff(np.append(run_at, len(cell))), np.add.reduceat(n, run_at)
    return *np.divmod(cell[run_at], ids), docs, n


def _spellings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Smallest string of each digest, and the largest if it is another; ``first`` is the first place of each, ``number`` the digest of each place."""
    data, at = _gathered(buf, starts[first], ends[first])
    low = pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    size = ends - starts
    same = size == size[first][number]
    for lo in range(0, len(starts), COMPARED):
        at = lo + np.flatnonzero(same[lo : lo + COMPARED])
        mine, begin = _gathered(buf, starts[at], ends[at])
        other, _ = _gathered(buf, starts[first][number[at]], ends[first][number[at]])
        same[at] = ~np.logical_or.reduceat(mine != other, begin[:-1]) if len(at) else True
    if same.all():
        return low, pa.nulls(len(first), pa.string())
    strings: dict[int, set[str]] = defaultdict(set)
    for i in np.flatnonzero(np.isin(number, number[~same])):
        strings[int(number[i])].add(buf[starts[i] : ends[i]].tobytes().decode())
    smallest = low.to_pylist()
    largest: list[str | None] = [None] * len(first)
    for k, found in strings.items():
        smallest[k], largest[k] = min(found, key=str.encode), max(found, key=str.encode)
    return pa.array(smallest, pa.string()), pa.array(largest, pa.string())


def _counted(known: Groups, group: np.ndarray, buf: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts and spellings of a slice of texts; what one step needs is gone before the next."""
    names = [f.split(" ")[0] for f in COUNTS.split(", ")]
    starts, ends, digest, text = _terms(buf, offsets, bits)
    if not len(starts):
        return
    ids, first, number = _numbered(digest)
    del digest
    g, at, docs, n = _sums(group, text, number, len(ids))
    del text
    for lo in range(0, len(g), HANDED):
        some = slice(lo, lo + HANDED)
        none = pa.nulls(len(g[some]), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(known.lang[g[some]]), pa.array(g[some].astype(np.int32)), pa.array(ids[at[some]]), pa.array(docs[some]), pa.array(n[some]), none, none], names)
    del g, at, docs, n
    none, gap = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64())
    spelt = pa.RecordBatch.from_arrays([none, none, pa.array(ids), gap, gap, *_spellings(buf, starts, ends, first, number)], names)
    del starts, ends, ids, first, number, buf
    for lo in range(0, spelt.num_rows, HANDED):
        yield spelt.slice(lo, HANDED)


def _count(known: Groups, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = known.of(batch)
            texts, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                yield from _counted(known, group[lo:hi], _TERM[texts[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], bits)

    return run


def _count_strings(known: Groups, bits: int, wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by string; ``wanted`` are the sorted digests to look at (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in SPLIT.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            group = known.of(batch)
            texts, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                buf = _TERM[texts[offsets[lo] : offsets[hi]]]
                starts, ends, digest, text = _terms(buf, offsets[lo : hi + 1] - offsets[lo], bits)
                look = np.arange(len(digest)) if wanted is None else np.flatnonzero(np.isin(digest, wanted))
                each = Counter((int(text[i]), int(digest[i]), buf[starts[i] : ends[i]].tobytes().decode()) for i in look)
                docs: Counter = Counter()
                n: Counter = Counter()
                for (t, d, term), k in each.items():
                    g = int(group[lo + t])
                    key = (int(known.lang[g]), g, d, term)
                    docs[key] += 1
                    n[key] += k
                columns = [list(c) for c in zip(*docs)] or [[], [], [], []]
                columns += [list(docs.values()), [n[k] for k in docs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return run


def _bounded(small: DataFrame, rows: int) -> DataFrame:
    """Sent to every task if it has few enough rows, else left to a shuffle."""
    return F.broadcast(small) if small.count() <= rows else small


def filled(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def term_counts(docs: DataFrame, known: Groups, least_docs: int = 30, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts ``lang, g, digest, part, n_docs, n`` of terms that may be kept, and their texts ``digest, part, item``."""
    rows = filled(docs, "lang", "source", "text")
    found = cut_lineage(rows.mapInArrow(_count(known, bits), COUNTS), "terms")
    counts = found.where("n_docs IS NOT NULL").groupBy("lang", "g", "digest").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    counts = cut_lineage(counts, "counts")
    enough = counts.groupBy("lang", "digest").agg(F.sum("n_docs").alias("d")).where(F.col("d") >= least_docs).select("digest").distinct()
    enough = cut_lineage(enough, "digests")
    spelt = found.where("low IS NOT NULL").select("digest", "low", F.coalesce("high", "low").alias("high")).join(_bounded(enough, KNOWN), "digest", "left_semi")
    spelt = cut_lineage(spelt.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")), "spellings")
    counts = counts.join(_bounded(enough, KNOWN), "digest", "left_semi").withColumn("part", F.lit(0))
    texts = spelt.where("low = high").select("digest", F.lit(0).alias("part"), F.col("low").alias("item"))
    shared = cut_lineage(spelt.where("low <> high").select("digest"), "shared")
    clashes = shared.count()
    if clashes == 0:
        return counts.select("lang", "g", *TERM, "n_docs", "n"), texts
    wanted = np.sort(np.array([r.digest for r in shared.collect()], np.int64)) if clashes <= KNOWN else None
    split = rows.mapInArrow(_count_strings(known, bits, wanted), SPLIT).join(shared, "digest", "left_semi")
    split = cut_lineage(split.groupBy("lang", "g", "digest", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")), "split")
    named = split.select("digest", "term").distinct().withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("term")))
    named = cut_lineage(named, "named")
    counts = counts.join(shared, "digest", "left_anti").unionByName(split.join(named, ["digest", "term"]).drop("term"))
    return counts.select("lang", "g", *TERM, "n_docs", "n"), texts.unionByName(named.select(*TERM, F.col("term").alias("item")))


def rate(count: Column, total: Column, terms: Column, smoothing: int, scale: int) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * terms))`` in whole numbers; null without terms."""
    upper = (count.cast("long") + smoothing).cast("decimal(20,0)") * F.lit(scale).cast("decimal(18,0)")
    lower = (total.cast("long") + terms.cast("long") * smoothing).cast("decimal(38,0)")
    return F.when(terms > 0, F.call_function("div", upper.cast("decimal(38,0)"), lower) + 1)


def _pair_sums(known: Groups, rest: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of differences for the tiles of a task.

    ``rest`` is each group's rate of a term that it does not hold.
    """

    def told(lang: int, tile: int, sums: np.ndarray) -> pa.RecordBatch:
        g, h = np.divmod(np.arange(sums.size), sums.shape[1])
        g = g + tile * TILE
        other = g != h
        return pa.RecordBatch.from_arrays([pa.array(g[other] + known.first[lang]), pa.array(h[other] + known.first[lang]), pa.array(sums.ravel()[other])], ["g", "h", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(0, np.int64)
        for batch in batches:
            langs, tiles = (batch.column(c).to_numpy() for c in ("lang", "tile"))
            cells = batch.column("cells")
            at, flat = cells.offsets.to_numpy(), cells.values  # null cells hold nothing
            g_all, p = flat.field("g").to_numpy(zero_copy_only=False), flat.field("p").to_numpy(zero_copy_only=False)
            begins = _runs(langs.astype(np.int64) * (1 << 40) + tiles)
            for lo, hi in zip(begins, np.append(begins[1:], len(langs))):
                key = (int(langs[lo]), int(tiles[lo]))
                begin = known.first[key[0]]
                base = rest[begin : begin + known.size[key[0]]]
                if key != now:
                    if now is not None:
                        yield told(*now, sums)
                    now, sums = key, np.zeros((min(TILE, len(base) - key[1] * TILE), len(base)), np.int64)
                step = max(1, CELLS // len(base))
                for i in range(lo, hi, step):
                    j = min(hi, i + step)
                    counts = np.diff(at[i : j + 1])
                    held = np.repeat(np.arange(j - i), counts)
                    table = np.repeat(base[None, :], j - i, axis=0)
                    table[held, g_all[at[i] : at[j]] - begin] = p[at[i] : at[j]]
                    table = table[counts > 0]
                    for k in range(len(sums)):
                        sums[k] += np.abs(table - table[:, key[1] * TILE + k, None]).sum(axis=0)
        if now is not None:
            yield told(*now, sums)

    return run


def audit(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, scale: int = 1_000_000_000, top: int = 50, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: the difference of every pair of sources of a language, and the terms a source favours.

    A language keeps the terms in at least ``least_docs`` of its documents.  ``bits`` is the width of a digest.
    """
    spark = docs.sparkSession
    known = Groups([(r.lang, r.source) for r in filled(docs, "lang", "source").distinct().collect()])
    counts, texts = term_counts(docs, known, least_docs, bits)
    kept = counts.groupBy("lang", *TERM).agg(F.sum("n_docs").alias("d"), F.sum("n").alias("in_lang")).where(F.col("d") >= least_docs).drop("d")
    kept = cut_lineage(kept, "kept")
    cells = cut_lineage(counts.join(kept, ["lang", *TERM]).select("lang", "g", *TERM, "n", "in_lang"), "cells")

    names = spark.createDataFrame([(g, int(known.lang[g]), *pair) for g, pair in enumerate(known.pairs)], "g int, lang int, lang_name string, source string")
    groups = names.join(cells.groupBy("g").agg(F.sum("n").alias("total")), "g", "left")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total")), "lang", "left")
    groups = groups.fillna(0, ["total", "v", "lang_total"])
    zero = rate(F.lit(0).cast("long"), F.col("total"), F.col("v"), smoothing, scale)
    groups = cut_lineage(groups.withColumn("p0", F.coalesce(zero, F.lit(0).cast("long"))), "groups")
    rest = np.zeros(len(known.pairs), np.int64)
    for r in groups.select("g", "p0").collect():
        rest[r.g] = r.p0

    total = groups.select("g", "total", "v", "lang_total")
    rated = cells.join(total, "g").select("*", rate(F.col("n"), F.col("total"), F.col("v"), smoothing, scale).alias("p"), rate(F.col("in_lang"), F.col("lang_total"), F.col("v"), smoothing, scale).alias("q"))
    favoured = rated.where("p > q").select("g", *TERM, (F.col("p") - F.col("q")).alias("value"))
    w = Window.partitionBy("g").orderBy(F.desc("value"))
    favoured = favoured.withColumn("r", F.rank().over(w)).where(F.col("r") <= top).drop("r").join(texts, TERM)
    favoured = favoured.withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    tiles = spark.createDataFrame([(i, (int(n) - 1) // TILE) for i, n in enumerate(known.size)], "lang int, tiles int")
    rows = rated.groupBy("lang", *TERM).agg(F.collect_list(F.struct("g", "p")).alias("cells")).join(tiles, "lang")
    rows = rows.select("lang", F.pmod(F.xxhash64(*TERM), F.lit(64)).alias("shard"), F.explode(F.sequence(F.lit(0), "tiles")).alias("tile"), "cells")
    rows = rows.unionByName(tiles.select("lang", F.lit(0).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), "tiles")).alias("tile"), F.array().cast(rows.schema["cells"].dataType).alias("cells")))
    sums = rows.repartition("lang", "tile", "shard").sortWithinPartitions("lang", "tile").select("lang", "tile", "cells")
    sums = sums.mapInArrow(_pair_sums(known, rest), "g long, h long, value long").groupBy("g", "h").agg(F.sum("value").alias("value"))
    pairs = sums.join(names.select(F.col("g").cast("long").alias("h"), F.col("source").alias("item")), "h")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item")))
    columns = ["g", "part", "item", "value", "rank"]
    found = pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(favoured.withColumn("part", F.lit("term")).select(columns))
    return found.join(names.select("g", F.col("lang_name").alias("lang"), "source"), "g").select("lang", "source", "part", "item", "value", "rank")
