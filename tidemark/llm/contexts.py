"""Language-model scores of whole texts by context-tree weighting.

A text counts as its words (A-Z lower-cased) joined by one blank and closed by a line feed.  Each of
its bytes is eight binary decisions; each decision has a tree over the preceding ``depth`` bytes
(line feeds before the text).  A node holds how often the decision went either way in the training
texts, its Krichevsky-Trofimov estimate, and the weighted probability
``Pw = (Pe + product of Pw over the contexts one byte longer) / 2``.  The probability of a decision
mixes the estimates of all depths by the odds ``Pe : product of Pw``.

1. Tasks count byte strings of ``depth + 1`` (of all texts, those outside the training texts with 0)
   and training words; both are summed in Spark.  All lower orders and all decisions follow from them.
2. Byte strings are dealt out by the two bytes before the last one: below depth 2 a tree lies in one
   task.  Depth 1 and 0 (at most 256 * 255 decisions) are summed in Spark, mixed on the driver and
   given to all tasks, which then price each byte string that occurs anywhere.
3. A score sums prices.  The most frequent keys (a fixed number at most) are sent to every task; the
   places of all other keys are joined with the table by shuffle.  A key outside the head is rare in
   the training texts, so the shuffled part is small and has no hot key.

Defined cases: a null text is empty and scores its end alone; without training texts every decision
has probability one half; a null id is neither learned from nor held out; repeated rows are scored
each.  Words are told apart by 64-bit digests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, _SEP, slices, text_buffer, words
from tidemark.session import cut_lineage

DEPTH = 5
HEAD = 1 << 21  # byte strings, and words, that are sent to every task at most
SHARD = 1 << 19  # byte strings priced by one task, about
SLICE = 2 << 20  # bytes of text worked on together
BYTES, WORDS, TEXTS = 0, 1, 2
COUNTS = "kind int, key long, n long"
SCORED = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, words array<long>, strings array<long>"


def stream(buf: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bytes of the canonical texts, and where each text's begin.

    A key holds the byte in its lowest eight bits, the byte before it in the next eight, and so on.
    """
    n = len(offsets) - 1
    b = np.insert(_LOWER[buf], np.repeat(offsets[1:], depth), 10)  # an end, then the context of the next text
    at = offsets[1:] + depth * np.arange(n)
    end, pad = np.zeros(len(b), bool), np.zeros(len(b), bool)
    end[at] = True
    pad[(at[:, None] + np.arange(1, depth)).ravel()] = True
    inside = ~_SEP[b]
    keep = inside | end | pad
    keep[1:] |= inside[:-1]
    b[~inside] = 32
    b[end | pad] = 10
    b, end, pad = b[keep], end[keep], pad[keep]
    blank = b == 32
    blank[:-1] &= end[1:]
    blank[-1:] = False
    b, end, pad = b[~blank], end[~blank], pad[~blank]
    full = np.concatenate((np.full(depth, 10, np.uint8), b))
    key = full[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        key |= full[depth - j : len(full) - j].astype(np.uint64) << np.uint64(8 * j)
    ends = np.flatnonzero(end[~pad]) + 1
    return key[~pad].view(np.int64), np.concatenate(([0], ends))


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if n is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n[order], at)


def _count(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, offsets = text_buffer(batch.column("text"))
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {BYTES: [], WORDS: []}
            for lo, hi in slices(offsets, SLICE):
                buf, off, known = texts[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], learn[lo:hi]
                keys, at = stream(buf, off, depth)
                mine = np.repeat(known, np.diff(at))
                found[BYTES].append(_counted(keys[mine]))
                other = _counted(keys[~mine])[0]
                found[BYTES].append((other, np.zeros(len(other), np.int64)))
                _, _, h, first = words(buf, off, lower=True)
                found[WORDS].append(_counted(h[np.repeat(known, np.diff(first))].view(np.int64)))
            for kind, parts in found.items():
                keys, n = _counted(*(np.concatenate(x) for x in zip(*parts))) if parts else _counted(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([0], pa.int64()), pa.array([int(learn.sum())], pa.int64())], ["kind", "key", "n"])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    a, b = a.astype(float), b.astype(float)
    return np.where(a + b == 0, 0.0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi))


class Decisions(NamedTuple):
    """Decision ``k`` at one depth: contexts and the byte's first ``k`` bits as keys, counts, and the place of each byte string's."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    place: np.ndarray


def decisions(strings: np.ndarray, n: np.ndarray, k: int) -> Decisions:
    key = strings >> np.uint64(8 - k)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.flatnonzero(first)
    one = ((strings >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
    ones = np.add.reduceat(n * one, at)
    return Decisions(key[at], np.add.reduceat(n, at) - ones, ones, np.cumsum(first) - 1)


class Tree:
    """The trees above some byte strings, from ``depth`` down to depth 2."""

    def __init__(self, strings: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        self.levels: dict[int, list[Decisions]] = {}
        self.weighted: dict[int, list[np.ndarray]] = {}
        self.below: dict[int, list[np.ndarray]] = {}
        for d in range(depth, 1, -1):
            if d < depth:
                strings, n = _counted(strings & np.uint64((1 << (8 * d + 8)) - 1), n)
            self.levels[d] = [decisions(strings, n, k) for k in range(8)]
            self.weighted[d], self.below[d] = [], []
            for k, level in enumerate(self.levels[d]):
                estimate = log_estimate(level.zeros, level.ones)
                if d == depth:
                    self.weighted[d].append(estimate)
                    continue
                longer = np.bincount(self.parent(d + 1, k), self.weighted[d + 1][k], len(level.key))
                self.below[d].append(longer)
                self.weighted[d].append(np.logaddexp(estimate, longer) - math.log(2))

    def parent(self, d: int, k: int) -> np.ndarray:
        """Place, one depth up, of each decision of depth ``d``."""
        return np.searchsorted(self.levels[d - 1][k].key, self.levels[d][k].key & np.uint64((1 << (8 * d - 8 + k)) - 1))

    def prices(self, top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 probability of each byte string's last byte; ``top`` has the mixture of depths 0 and 1 per decision."""
        total = np.zeros(len(self.levels[self.depth][0].place))
        for k in range(8):
            for d in range(2, self.depth + 1):
                level = self.levels[d][k]
                if d == 2:
                    keys, mixed, left = top[k]
                    up = np.searchsorted(keys, level.key & np.uint64((1 << (8 + k)) - 1))
                else:
                    up = self.parent(d, k)
                one = (level.ones + 0.5) / (level.zeros + level.ones + 1.0)
                if d < self.depth:
                    share = odds_share(log_estimate(level.zeros, level.ones), self.below[d][k])
                    mixed, left = mixed[up] + left[up] * share * one, left[up] * (1 - share)
                else:
                    mixed = mixed[up] + left[up] * one
            level = self.levels[self.depth][k]
            total += np.log10(np.where(self.bits(k), mixed[level.place], 1 - mixed[level.place]))
        return total

    def bits(self, k: int) -> np.ndarray:
        last = self.levels[self.depth][7]
        if k < 7:
            return ((last.key[last.place] >> np.uint64(6 - k)) & np.uint64(1)).astype(bool)
        return self.last_bit

    last_bit: np.ndarray


def odds_share(estimate: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate in its mixture."""
    return 1 / (1 + np.exp(np.clip(longer - estimate, -700, 700)))


def _tree(batches: Iterator[pa.RecordBatch], depth: int) -> tuple[Tree, np.ndarray, np.ndarray] | None:
    have = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
    if not have:
        return None
    keys, n = (np.concatenate(x) for x in zip(*have))
    order = np.argsort(keys)
    keys, n = keys[order].view(np.uint64), n[order]
    tree = Tree(keys, n, depth)
    tree.last_bit = (keys & np.uint64(1)).astype(bool)
    return tree, keys, n


def _lower_ends(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and weighted probabilities of depth 2, summed by their context of one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _tree(batches, depth)
        if built is None:
            return
        for k, level in enumerate(built[0].levels[2]):
            up, place = np.unique(level.key & np.uint64((1 << (8 + k)) - 1), return_inverse=True)
            sums = [np.bincount(place, x, len(up)) for x in (level.zeros, level.ones, built[0].weighted[2][k])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(up), k, np.int32)), pa.array(up.view(np.int64)), *(pa.array(x) for x in sums)], ["k", "key", "zeros", "ones", "longer"])

    return run


def _mixed_top(rows: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of depth 1 per decision, the probability of a one mixed from depths 0 and 1, and the weight left for longer contexts."""
    out = []
    for k in range(8):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.key)
        key = np.array([r.key for r in mine], np.int64).view(np.uint64)
        zeros, ones, longer = (np.array([r[i] for r in mine], float) for i in (2, 3, 4))
        estimate = log_estimate(zeros, ones)
        share = odds_share(estimate, longer)
        weighted = np.logaddexp(estimate, longer) - math.log(2)
        up, place = np.unique(key & np.uint64((1 << k) - 1), return_inverse=True)
        a, b, w = (np.bincount(place, x, len(up)) for x in (zeros, ones, weighted))
        root = odds_share(log_estimate(a, b), w)
        mixed, left = (root * (b + 0.5) / (a + b + 1))[place], (1 - root)[place]
        out.append((key, mixed + left * share * (ones + 0.5) / (zeros + ones + 1), left * (1 - share)))
    return out


def _price(depth: int, top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _tree(batches, depth)
        if built is not None:
            tree, keys, n = built
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(tree.prices(top))], ["key", "n", "price"])

    return run


class Model(NamedTuple):
    depth: int
    strings: DataFrame  # key, n, price: log10 probability of the last byte after the others
    words: DataFrame  # key, n
    tokens: int  # in the training texts, ends included
    distinct: int
    texts: int


def fit(docs: DataFrame, learn, depth: int = DEPTH) -> Model:
    """The model of the rows for which ``learn`` holds; byte strings of all ``docs`` are priced."""
    rows = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = rows.mapInArrow(_count(depth), COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts, "counts")
    strings, known = (counts.where(F.col("kind") == k).select("key", "n") for k in (BYTES, WORDS))
    texts = counts.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    tokens, distinct = known.agg(F.sum("n"), F.count("*")).first()
    shards = max(1, -(-strings.count() // SHARD))
    # below two bytes of context a tree is whole in its task
    dealt = strings.repartition(shards, F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    ends = dealt.mapInArrow(_lower_ends(depth), "k int, key long, zeros double, ones double, longer double")
    top = _mixed_top(ends.groupBy("k", "key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer"))).collect())  # 256 * 255 rows at most
    priced = cut_lineage(dealt.mapInArrow(_price(depth, top), "key long, n long, price double"), "prices")
    return Model(depth, priced, known, (tokens or 0) + texts, distinct + (texts > 0), texts)


def head(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the largest ``n``, at most ``most`` of them, and all others; rows are told apart by powers of two of ``n``."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r[0]: r[1] for r in table.where("n > 0").groupBy(level.alias("l")).count().collect()}
    least, room = None, most
    for size in sorted(sizes, reverse=True):
        room -= sizes[size]
        if room < 0:
            break
        least = 1 << size
    if least is None:
        return table.where("false"), table
    return table.where(F.col("n") >= least), table.where(F.col("n") < least)


def _known_values(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys (0 where there is none), and where there is none; ``keys`` are sorted."""
    order = np.argsort(wanted)
    ordered = wanted[order]
    at = np.minimum(np.searchsorted(keys, ordered), max(len(keys) - 1, 0))
    hit = keys[at] == ordered if len(keys) else np.zeros(len(ordered), bool)
    value, gone = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    value[order[hit]] = values[at[hit]]
    gone[order[hit]] = False
    return value, gone


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between neighbouring places of ``at``; the same for a text whatever stands beside it."""
    out = np.zeros(len(at) - 1, values.dtype)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, at[:-1][some])[: len(some)]
    return out


def _lists(values: np.ndarray, gone: np.ndarray, at: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(gone)))[at]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[gone]))


def _score(depth: int, strings: Broadcast, known: Broadcast, tokens: int, distinct: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = tokens + 0.5 * (distinct + 1)
        price_keys, prices = strings.value
        word_keys, counts = known.value
        logs = np.log10((counts + 0.5) / lower)
        end = math.log10((texts + 0.5) / lower)
        row = TaskContext.get().partitionId() << 40
        names = [c.split(" ")[0] for c in SCORED.split(", ")]
        for batch in batches:
            buffer, offsets = text_buffer(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                buf, off = buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                keys, at = stream(buf, off, depth)
                price, dear = _known_values(price_keys, prices, keys)
                _, _, h, first = words(buf, off, lower=True)
                h = h.view(np.int64)
                base, rare = _known_values(word_keys, logs, h)
                n_known = _sums((~rare).astype(np.int64), first) + (texts > 0)
                rows = np.arange(row, row + hi - lo)
                row += hi - lo
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(np.diff(at)), pa.array(np.diff(first) + 1), pa.array(n_known),
                    pa.array(_sums(base, first) + end), pa.array(_sums(price, at)), _lists(h, rare, first), _lists(keys, dear, at),
                ], names)

    return run


def _sent(table: DataFrame, value: str) -> Broadcast:
    rows = table.select("key", F.col(value).alias("value")).toArrow()
    keys, values = rows["key"].to_numpy(), rows["value"].to_numpy()
    order = np.argsort(keys)
    return table.sparkSession.sparkContext.broadcast((keys[order], values[order].astype(float)))


def score(docs: DataFrame, model: Model, held_out, most: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    ``score`` is the log10 probability of the text, ``bits_per_byte`` its code length.  ``most`` bounds what is broadcast.
    """
    frequent, others = head(model.strings, most)
    usual, unusual = head(model.words, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(_score(model.depth, _sent(frequent, "price"), _sent(usual, "n"), model.tokens, model.distinct, model.texts), SCORED)
    scored = cut_lineage(scored, "scores")

    lower = float(model.tokens + 0.5 * (model.distinct + 1))
    places = scored.select("row", F.explode("words").alias("key")).groupBy("row", "key").agg(F.count("*").alias("k")).join(unusual, "key", "left")
    found = F.coalesce(F.col("n"), F.lit(0))
    more_words = places.select("row", (F.col("k") * F.log10((found + 0.5) / lower)).alias("base"), F.when(found > 0, F.col("k")).otherwise(0).alias("known"), F.lit(0.0).alias("price"))
    places = scored.select("row", F.explode("strings").alias("key")).groupBy("row", "key").agg(F.count("*").alias("k")).join(others, "key")
    more_strings = places.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("k") * F.col("price")).alias("price"))
    more = more_words.unionByName(more_strings).groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("base", "known", "price")))
    out = scored.drop("words", "strings").join(more, "row", "left").fillna(0, ["more_base", "more_known", "more_price"])
    total = F.col("score") + F.col("more_price")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"), total.alias("score"), (-total / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
