"""Exact byte-level deduplication by sorting suffixes block by block, with a difference cover.

A byte goes when it lies in a string of 400 bytes that also starts anywhere else.  Every suffix
that begins such a string belongs to one *bucket*, named by the least 64-byte fingerprint inside
its first 400 bytes, so equal strings always share a bucket.  Buckets whose suffixes all come from
one content, or whose contents are seen twice whole, are settled by counting (``repeats``).  Of the
others, each content is sent once, and many buckets together form a block of bounded size.

A block sorts the suffixes of one bucket at a time.  The contents are laid out so that their
anchors fall on multiples of 32; the ranks of the suffixes at the places of a difference cover
modulo 32 are computed first, by their first 32 bytes and then by doubling to 256.  Two suffixes
of a bucket then compare by the ranks of their first and their last covered place, which settles
everything but up to 31 bytes at either end, compared directly.  Memory is that of the block's
text and its cover.

A bucket of very many contents would not fit a block.  Its contents are cut into parts of 16
windows and counted by what all windows of a part hold; only parts that share this, but not
everything, are compared window by window, by 128-bit fingerprints that Spark counts.  All this
reads the contents that were sent; the texts are gone through once.

Defined cases: a null text is empty; texts shorter than 400 bytes keep everything; strings never
span texts; rows that repeat are texts of their own; runs of one byte and very long texts are
handled like any others (long ones in overlapping pieces).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SUB_BATCH, Prefix, mix, seeded
from tidemark.llm.repeats import KEYS, Units, covered, digest, repeated_hashes, repeated_windows, with_speakers
from tidemark.session import cut_lineage

LENGTH = 400
GRAM = 64  # bytes of the fingerprint that names a bucket
MODULUS = 32
REACH = 256  # bytes that a cover rank tells apart
BLOCK_BYTES = 4 << 20
MOST_CONTENTS = 2_000  # contents of a bucket that are sorted in one block
PART = 16  # windows of a part
_BYTE = seeded(256, 606)
_MIX = seeded(4, 707)


def difference_cover(v: int) -> list[int]:
    """Residues of which some two differ by any given amount modulo ``v``, chosen greedily."""
    cover, have = [0], {0}
    while len(have) < v:
        best = max(range(v), key=lambda x: (len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) - have), -x))
        have |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(MODULUS)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, prefix: Prefix, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of a piece of text: the place of its anchor and the fingerprint there."""
    at = np.arange(len(buf) - gram + 1)
    h = prefix.of(at, at + gram)
    packed = (h >> np.uint64(22) << np.uint64(22)) | at.astype(np.uint64)  # pieces are shorter than 4 MB
    least = _sliding_least(packed, length - gram + 1)
    place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    return place, h[place]


def byte_units(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Units:
    """Units of several texts; starts count bytes within their text."""
    parts = []
    i, n = 0, len(offsets) - 1
    while i < n:
        size = offsets[i + 1] - offsets[i]
        if size > 2 * SUB_BATCH:  # a long text in pieces that overlap by a window less one
            for s in range(0, size - length + 1, SUB_BATCH):
                e = min(size, s + SUB_BATCH + length - 1)
                parts.append(_piece_units(buf[offsets[i] + s : offsets[i] + e], np.array([0, e - s]), np.array([i]), s, length, gram))
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= 2 * SUB_BATCH:
            j += 1
        parts.append(_piece_units(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j), 0, length, gram))
        i = j
    parts = [p for p in parts if len(p.u)]
    return Units(*(np.concatenate(x) for x in zip(*parts))) if parts else Units(*(np.zeros(0, np.int64) for _ in range(5)))


def _piece_units(buf: np.ndarray, offsets: np.ndarray, names: np.ndarray, base: int, length: int, gram: int) -> Units:
    if len(buf) < length:
        return Units(*(np.zeros(0, np.int64) for _ in range(5)))
    prefix = Prefix(_BYTE[buf])
    place, found = anchors(buf, prefix, length, gram)
    sizes = np.diff(offsets)
    whole = np.flatnonzero(sizes >= length)
    room = sizes[whole] - length + 1
    own = np.repeat(whole, room)
    starts = offsets[:-1][own] + np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room)
    if not len(starts):
        return Units(*(np.zeros(0, np.int64) for _ in range(5)))
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (place[starts[1:]] != place[starts[:-1]])
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    shift = (place[first] - first).astype(np.uint64)
    hull = mix(prefix.of(first, last + length) + shift * _MIX[0] + (last - first).astype(np.uint64) * _MIX[1])
    at = base - offsets[:-1][own[head]]
    return Units(names[own[head]], found[first].view(np.int64), hull.view(np.int64), first + at, last + at)


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by their columns, the first one leading."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts like them."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + k].astype(np.uint64)
    return out


def cover_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of the first 256 bytes at every place of the cover (0 elsewhere); ``text`` ends with as many blanks."""
    n = len(text) - REACH
    places = np.arange(n)
    places = places[np.isin(places % MODULUS, COVER)]
    rank = np.zeros(len(text), np.int64)
    rank[places] = 1 + _names(*(_eight(text, places + k) for k in range(0, MODULUS, 8)))
    step = MODULUS
    while step < REACH:  # a shift by a multiple of the modulus leads to a covered place again
        rank[places] = 1 + _names(rank[places], rank[places + step])
        step *= 2
    return rank


def repeated_in_block(contents: list[bytes], shifts: np.ndarray, buckets: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every content, which of its windows also start in another content of the same bucket.

    ``shifts``: place of the anchor in each content.
    """
    sizes = np.array([len(c) for c in contents])
    lead = (-shifts) % MODULUS  # anchors fall on multiples of the modulus
    room = lead + sizes
    begin = np.concatenate([[0], np.cumsum(-(-room // MODULUS) * MODULUS)])
    text = np.zeros(begin[-1] + REACH + MODULUS, np.uint8)
    for c, b, d in zip(contents, begin, lead):
        text[b + d : b + d + len(c)] = np.frombuffer(c, np.uint8)
    rank = cover_ranks(text)
    count = sizes - length + 1
    own = np.repeat(np.arange(len(contents)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    start = (begin[:-1] + lead)[own] + at
    offset = at - shifts[own]
    ahead = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])  # to the next covered place
    behind = np.array([min((r - c) % MODULUS for c in COVER) for r in range(MODULUS)])
    low = start + ahead[start % MODULUS]
    high = start + length - REACH
    high = high - behind[high % MODULUS]
    name = _names(buckets[own], offset, rank[low])
    open_ = np.arange(len(own))

    def tied(name: np.ndarray) -> np.ndarray:
        return np.bincount(name, minlength=1)[name] > 1

    # longer and longer comparisons, only among suffixes that are still tied
    columns = [lambda x: rank[high[x]], *(lambda x, k=k: _eight(text, start[x] + k) for k in range(0, MODULUS, 8)), *(lambda x, k=k: _eight(text, start[x] + length - 8 - k) for k in range(0, MODULUS, 8))]
    for column in columns:
        keep = tied(name)
        open_, name = open_[keep], name[keep]
        if not len(open_):
            break
        name = _names(name, column(open_))
    hit = np.zeros(len(own), bool)
    if len(open_):
        hit[open_[tied(name)]] = True
    return np.split(hit, np.cumsum(count)[:-1])


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated_byte_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, most: int = MOST_CONTENTS) -> DataFrame:
    """``doc_id, k, ranges`` of byte positions at which strings start that also start elsewhere."""
    if length < REACH + 2 * MODULUS:
        raise ValueError(f"length must be at least {REACH + 2 * MODULUS}")

    def shifts_of(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How far behind its first window the anchor of each unit lies, found as in ``anchors``."""
        at = np.arange(length - gram + 1)
        return np.array([np.argmin(Prefix(_BYTE[buf[f : f + length]]).of(at, at + gram) >> np.uint64(22)) for f in first], np.int64)

    def contents_of(buf: np.ndarray, u, hull, first, last, base) -> Iterator[pa.RecordBatch]:
        raw, shift = buf.tobytes(), shifts_of(buf, first)
        contents = pa.array([raw[f : e + length] for f, e in zip(first, last)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(hull), pa.array(shift), contents], [*KEYS, "shift", "content"])

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contents in parts of neighbouring windows, cut at fixed distances from the anchor: what all windows of a part hold, and what any does."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                u, hull, shift = (rows.column(c).to_numpy() for c in (*KEYS, "shift"))
                contents = rows.column("content").to_pylist()
                ends = np.cumsum([len(c) for c in contents])
                first, last = np.append(0, ends[:-1]), ends - length
                prefix, anchor = Prefix(_BYTE[np.frombuffer(b"".join(contents), np.uint8)]), first + shift
                low, high = (first - anchor) // PART, (last - anchor) // PART
                own = np.repeat(np.arange(len(u)), high - low + 1)
                begin = anchor[own] + PART * (low[own] + np.arange(len(own)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
                a, b = np.maximum(first[own], begin), np.minimum(last[own], begin + PART - 1)
                core = mix(prefix.of(begin + PART - 1, begin + length) + (begin - anchor[own]).astype(np.uint64) * _MIX[3] + u[own].view(np.uint64))
                whole = mix(prefix.of(a, b + length) + (a - begin).astype(np.uint64) * _MIX[0] + (b - a).astype(np.uint64) * _MIX[1])
                columns = (u[own], hull[own], a - first[own], b - first[own], core.view(np.int64), whole.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEYS, "a", "b", "core", "whole"])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, hull, content, ranges in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "content", "ranges"))):
                buf = np.frombuffer(content, np.uint8)
                prefix, second = Prefix(_BYTE[buf]), Prefix(mix(_BYTE[buf] ^ _MIX[2]))
                at = np.concatenate([np.arange(r["a"], r["b"] + 1) for r in ranges])
                h = [hashlib.blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest() for a, b in zip(prefix.of(at, at + length), second.of(at, at + length))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), u)), pa.array(np.full(len(at), hull)), pa.array(at), pa.array(h, pa.binary())], [*KEYS, "at", "h"])

    def sort_block(rows: pa.Table) -> pa.Table:
        u, hull, shift = (rows.column(c).to_numpy() for c in (*KEYS, "shift"))
        found = [_runs(h) for h in repeated_in_block(rows.column("content").to_pylist(), shift, u, length)]
        own = np.repeat(np.arange(len(u)), [len(a) for a, _ in found])
        a, b = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        return pa.table({"u": u[own], "hull": hull[own], "a": a, "b": b})

    def resolve(texts: DataFrame, speakers: DataFrame) -> DataFrame:
        few, many = speakers.where(F.col("hulls") <= most), speakers.where(F.col("hulls") > most)
        size = few.agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
        blocks = max(1, -(-int(size) // block_bytes))
        contents = with_speakers(texts, speakers, contents_of, "u long, hull long, shift long, content binary")

        def sorted_(contents: DataFrame) -> DataFrame:
            block = F.pmod(F.xxhash64("u"), F.lit(blocks))
            return contents.withColumn("block", block).groupBy("block").applyInArrow(sort_block, "u long, hull long, a long, b long")

        if many.isEmpty():
            return sorted_(contents)
        # many contents: first in parts, then window by window where parts share what all their windows hold
        crowded = cut_lineage(many.select("u").distinct(), "crowded")  # few rows: each stands for more than `most`
        contents = cut_lineage(contents, "contents")
        of_many = contents.join(crowded, "u", "left_semi")
        parts = cut_lineage(of_many.mapInArrow(parts_of, "u long, hull long, a long, b long, core long, whole long"), "parts")
        same = parts.groupBy("core", "whole").agg(F.count("*").alias("n"))
        shared = same.groupBy("core").agg(F.sum("n").alias("t"), F.count("*").alias("wholes")).where("t > 1").select("core", "wholes")
        parts = cut_lineage(parts.join(same.join(shared, "core"), ["core", "whole"]), "parts")
        rest = parts.where("wholes > 1").groupBy(*KEYS).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
        windows = of_many.join(rest, KEYS).select(*KEYS, "content", "ranges").mapInArrow(windows_of, "u long, hull long, at long, h binary")
        found = sorted_(contents.join(crowded, "u", "left_anti")).union(parts.where("n > 1").select(*KEYS, "a", "b"))
        return found.union(repeated_hashes(windows))

    return repeated_windows(docs, lambda b, o: byte_units(b, o, length, gram), resolve)


def _kept(text: bytes, ranges: list[dict] | None, length: int) -> tuple[int, int, int, bytes]:
    if not ranges:
        return len(text), 0, 0, text
    gone = covered(ranges, len(text), length)
    starts, _ = _runs(gone)
    return len(text), int(gone.sum()), len(starts), np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """Each row of ``docs(doc_id, text)``: ``n_bytes, n_removed, n_spans, kept`` (binary: what stays)."""
    return digest(docs, repeated_byte_windows(docs, length, **how), lambda t, r: _kept(t, r, length), "n_bytes long, n_removed long, n_spans long, kept binary")


def removal_digest(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """As ``remove_repeats``, with the sha256 of the kept bytes for the bytes."""

    def run(text: bytes, ranges: list[dict] | None):
        n, gone, spans, kept = _kept(text, ranges, length)
        return n, gone, spans, hashlib.sha256(kept).hexdigest()

    return digest(docs, repeated_byte_windows(docs, length, **how), run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
