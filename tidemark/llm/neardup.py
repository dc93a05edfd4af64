"""Near-duplicate documents by SetSketch registers, exact after verification.

1. A document is the set of its word shingles.  Its sketch keeps, for each of 256 registers, the
   smallest of the exponentially distributed values that the shingles have there, truncated to a
   power of the base.  Sketches of parts merge by the maximum, and two registers agree with a
   probability close to the Jaccard similarity.
2. Documents of equal sets are one class.  Runs of six registers are banded; classes that share a
   band are candidates.  A pair at the threshold misses all bands with a probability of 3e-6.
3. Inside a band nothing is paired with everything: each class meets the *hub* of its band, the class
   that shares the most bands with others, as the original of many copies does.  The similarity is
   estimated from both sketches by maximum likelihood, then pairs that are not clearly too far are
   verified on the whole sets, and linked classes become components.
4. Bands that still hold several components are settled exactly: their classes meet on their rarest
   shingles (two sets above the threshold must share one of the rarest n - ceil(t n) + 1), only across
   components and only where enough shingles follow in both sets to reach the threshold.  The largest
   component at a shingle meets the others, never itself.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat an id are one node; a null id counts
as the smallest id; ties at the threshold are links; texts are read whole; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, seeded, slices, text_buffer, words
from tidemark.llm.components import components
from tidemark.session import cut_lineage

REGISTERS = 256
BAND = 6
BANDS = REGISTERS // BAND
LOG_BASE = float(np.log(1.02))
RATE = 20.0
MARGIN = 0.2  # a pair whose estimate lies further than this below the threshold is not verified: six standard errors
NO_ID = -(1 << 63)

_A, _B = seeded(2, 101)
_STEP = seeded(REGISTERS, 202)
_BAND_SEED = seeded(BANDS, 303)
_PLACE = seeded(BAND, 404) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and their counts."""
    _, _, h, first = words(buf, offsets, lower=True)
    sizes = np.diff(first)
    rows = np.repeat(np.arange(len(sizes)), np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(int)))
    full = np.repeat(first[:-1], np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(int)))
    at = full + np.arange(len(rows)) - np.searchsorted(rows, rows)
    span = np.minimum(n, sizes)[rows]
    s = span.astype(np.uint64)
    for k in range(n):
        inside = k < span
        s = np.where(inside, mix(s * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, len(h) - 1)]) if len(h) else s, s)
    if not len(rows):
        return s, np.zeros(len(sizes), np.int64)
    order = np.lexsort((s, rows))
    rows, s = rows[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (s[1:] != s[:-1])
    return s[new], np.bincount(rows[new], minlength=len(sizes))


def sketches(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers of each set.  An element's j-th smallest value lies in the j-th of equally likely intervals and goes to
    its own j-th register, so a set is done once all its registers hold values below the next interval."""
    n, m = len(counts), REGISTERS
    least = np.full(n * m, 1.0)
    row = np.repeat(np.arange(n), counts)
    a, b, el = mix(s ^ _A), mix(s ^ _B) | np.uint64(1), s
    for j in range(m):
        if not len(row):
            break
        u = (mix(el + _STEP[j]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        reg = ((a + b * np.uint64(j)) & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(least, row * m + reg, (j + u) / m)
        open_ = least.reshape(n, m).max(axis=1) > (j + 1) / m
        keep = open_[row]
        if not keep.all():
            row, a, b, el = row[keep], a[keep], b[keep], el[keep]
    x = -np.log1p(-np.minimum(least, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / LOG_BASE), 0, 65535).astype(np.uint16).reshape(n, m)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch."""
    r = registers[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
    return mix((mix(r + _PLACE) * _PLACE).sum(axis=2, dtype=np.uint64) + _BAND_SEED).view(np.int64)


def likely_similarity(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches by maximum likelihood, the set sizes being known."""
    b = np.exp(LOG_BASE)
    above, below = (k1 > k2).sum(axis=1), (k1 < k2).sum(axis=1)
    equal = k1.shape[1] - above - below
    u = (n1 / (n1 + n2))[:, None]
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / LOG_BASE

    more, less = p(u - (1 - u) * j), p(1 - u - u * j)
    tiny = 1e-12
    fit = above[:, None] * np.log(more + tiny) + below[:, None] * np.log(less + tiny) + equal[:, None] * np.log(np.maximum(1 - more - less, tiny))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def _each(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    buf, offsets = text_buffer(column)
    for i, j in slices(offsets):
        yield shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)


def sketch_table(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, k`` (hash of the text), ``size`` of the set, ``s1, s2`` (hashes of the set), ``bands`` and ``registers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, bands, kept = [], [], [], [], []
            for s, counts in _each(batch.column(2), n):
                ends = np.cumsum(counts)
                for out, h in ((one, mix(s + np.uint64(5))), (two, mix(s ^ np.uint64(0xABCDEF)))):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
                    out.append(mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64))
                sizes.append(counts)
                registers = sketches(s, counts)
                bands.append(bands_of(registers))
                kept += [r.tobytes() for r in registers]
            flat = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
            array = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, BANDS, dtype=np.int32)), pa.array(flat.reshape(-1)))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cat(sizes), cat(one), cat(two), array, pa.array(kept, pa.binary())], ["doc_id", "k", "size", "s1", "s2", "bands", "registers"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    return rows.mapInArrow(run, "doc_id long, k long, size long, s1 long, s2 long, bands array<long>, registers binary")


def set_table(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Sets of the classes ``wanted(node, low, k)``, read from the document ``low``: ``node, size, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for s, counts in _each(batch.column(1), n):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), pa.array(counts), lists], ["node", "size", "shingles"])
                at += len(counts)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("low"), F.xxhash64("text").alias("k"), "text")
    return texts.join(wanted, ["low", "k"]).select("node", "text").mapInArrow(run, "node long, size long, shingles array<long>").dropDuplicates(["node"])


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` that are not clearly too far by the estimate from their registers."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                k1, k2 = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : BANDS * BAND] for i in (2, 3))
                n1, n2 = (part.column(i).to_numpy().astype(float) for i in (4, 5))
                keep = pa.array(likely_similarity(k1, k2, n1, n2) >= threshold - MARGIN)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    per_cent = round(threshold * 100)
    small = classes.select("node", "size", "registers")
    x, y = small.toDF("a", "na", "ra"), small.toDF("b", "nb", "rb")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent
    return pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", "ra", "rb", "na", "nb").mapInArrow(estimate, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""
    per_cent = round(threshold * 100)
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * per_cent).select("a", "b")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _hubs(members: DataFrame) -> DataFrame:
    """The member of each band that meets the most others over all its bands: ``band, hub, of`` (its component)."""
    meets = members.join(members.groupBy("band").agg(F.count("*").alias("n")), "band").groupBy("node").agg(F.sum("n").alias("meets"))
    best = F.max(F.struct("meets", "node", "component")).alias("hub")
    return members.join(meets, "node").groupBy("band").agg(best).select("band", F.col("hub.node").alias("hub"), F.col("hub.component").alias("of"))


def _hub_pairs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each node with the hubs of every band it is in, where their components differ; ``members(no, band, node, component)``."""
    pairs = members.join(hubs, "band").where("component <> of")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _several(members: DataFrame) -> DataFrame:
    """The members of bands that hold more than one component."""
    open_ = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return members.join(open_, "band", "left_semi")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.select("no", "band", "node").join(found, "node", "left").select("no", "band", "node", F.coalesce("component", "node").alias("component"))


def rare_token_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs across components that can reach the threshold, by their rarest shingles."""
    nodes = members.select("node", "component").distinct()
    each = sets.join(nodes, "node").select("node", "component", "size", F.explode("shingles").alias("token"))
    ranked = each.join(each.groupBy("token").count().where("count > 1"), "token", "left")  # alone: rarest, but meets nobody
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "token")))
    per_cent = round(threshold * 100)
    prefix = F.col("size") - F.ceil(F.col("size") * per_cent / 100) + 1  # whole numbers: no rounding error reaches the ceiling
    first = ranked.groupBy("node", "component", "size").agg(order.alias("o"))
    first = first.select("node", "component", "size", F.posexplode(F.slice("o", F.lit(1), prefix.cast("int"))).alias("place", "t")).where("t.count > 1")
    first = first.select("node", "component", "size", (F.col("size") - F.col("place")).alias("left"), F.col("t.token").alias("token"))
    sizes = first.groupBy("token", "component").agg(F.count("*").alias("n"))
    shared = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1").select("token", F.col("most.component").alias("most"))
    first = cut_lineage(first.join(shared, "token"), "rare")
    x = first.where("component <> most").drop("most").toDF(*(f"{c}_a" if c != "token" else c for c in first.columns if c != "most"))
    y = first.toDF(*(f"{c}_b" if c != "token" else c for c in first.columns))
    # at the first shingle that both share, what is left of each set must still reach the overlap that the threshold asks for
    enough = F.least("left_a", "left_b") * (100 + per_cent) >= (F.col("size_a") + F.col("size_b")) * per_cent
    once = (F.col("component_b") == F.col("most_b")) | (F.col("node_a") < F.col("node_b"))
    pairs = x.join(y, "token").where((F.col("component_a") != F.col("component_b")) & enough & once)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with ``n_shingles``, ``component_id`` and ``kept``; also ``k``, the hash of its text.

    Runs several jobs; all that is read more than once is written to the shared folder.
    """
    sketched = cut_lineage(sketch_table(docs, shingle), "sketches")
    classes = cut_lineage(
        sketched.where("size > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "k", "size", "bands", "registers")).alias("r")).select("s1", "s2", F.col("s1").alias("node"), F.col("r.doc_id").alias("low"), "r.k", "r.size", "r.bands", "r.registers"), "classes"
    )
    banded = classes.select("node", F.posexplode("bands").alias("no", "h")).select("no", "node", F.xxhash64("no", "h").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band")
    members = cut_lineage(banded.join(shared, "band", "left_semi").withColumn("component", F.col("node")), "bands")
    # an id that stands for texts of several classes ties those together
    of_id = sketched.where("size > 0").select("doc_id", "s1", "s2").distinct().join(classes.select("s1", "s2", "node"), ["s1", "s2"])
    ties = of_id.groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1).select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b"))
    source = classes.select("node", "low", "k")
    hubs = cut_lineage(_hubs(members), "hubs")
    pairs = cut_lineage(likely(_hub_pairs(members, hubs), classes, threshold), "likely")
    sets = cut_lineage(set_table(docs, _nodes(pairs).join(source, "node"), shingle), "sets")
    found = cut_lineage(components(ties.union(verified(pairs, sets, threshold))), "components")
    # a hub has met everyone in its band
    members = members.join(hubs.select("band", F.col("hub").alias("node")), ["band", "node"], "left_anti")
    members = cut_lineage(_several(_labelled(members, found)), "bands")
    if not members.isEmpty():
        sets = cut_lineage(set_table(docs, members.select("node").distinct().join(source, "node"), shingle), "sets")
        pairs = likely(rare_token_pairs(members, sets, threshold), classes, threshold)
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(pairs, sets, threshold)))
    by_class = classes.select("s1", "s2", "node", "low").join(found, "node", "left").select("s1", "s2", "low", F.coalesce("component", "node").alias("component"))
    least = by_class.groupBy("component").agg(F.min("low").alias("least"))
    by_class = by_class.join(least, "component").select("s1", "s2", "least")
    out = sketched.select("doc_id", "k", "size", "s1", "s2").join(by_class, ["s1", "s2"], "left")
    least = F.coalesce("least", "doc_id")
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "k", F.col("size").alias("n_shingles"),
        F.when(least != NO_ID, least).alias("component_id"), (least == F.col("doc_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest id.

    Of rows that repeat its id and text any one stays; of texts that share its id the one whose hash is smallest.
    """
    marks = cut_lineage(near_duplicates(docs, shingle, threshold), "marks")
    kept = marks.where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__d"), "k").groupBy("__d").agg(F.min("k").alias("__k"), F.count("*").alias("__n"))
    repeated = kept.where("__n > 1").isEmpty() is False
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__h": F.xxhash64("text")})
    out = rows.join(kept, (F.col("__id") == F.col("__d")) & (F.col("__h") == F.col("__k")))
    return (out.dropDuplicates(["__id"]) if repeated else out).select(*(f"`{c}`" for c in docs.columns))
