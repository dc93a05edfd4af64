"""Substring deduplication over words by recompression.

A text is a string of word symbols.  In every round runs of equal symbols and pairs (left symbol,
right symbol) are replaced by one symbol each; which symbols are left ones is a hash of the symbol
and the round.  The name of a symbol is the fingerprint of the words it stands for, so names are
the same in every task and document without a table of names, and equal substrings get equal
symbols inside, up to a margin at their ends.

The margin is tracked: every boundary between symbols carries the interval of words that its
existence depends on.  A window of 35 words is anchored at a boundary of the highest round that
has one whose interval lies within the window, of several at the one whose interval has the least
fingerprint.  Any equal window has that boundary at the same offset, so shared symbols reveal all
repeats; equal windows are then verified by the fingerprints of their words.

Defined cases: a null text has no words; a text shorter than a window keeps everything; windows
never span texts; rows that repeat are texts of their own, and so repeat each other; a run of one
word, however long, is handled like any other text; very long texts are parsed in overlapping
pieces, which gives the same anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Prefix, mix, seeded, words
from tidemark.llm.repeats import Units, covered, digest, repeated_hashes, repeated_windows, with_speakers

WINDOW = 35
ROUNDS = 4
SHORT = 6  # an anchor that depends on fewer words would be too common
PIECE = 1 << 17  # words parsed together
_ROUND = seeded(64, 505)
_END = np.uint64(0x5BF0A8B1457E3D21)  # stands between texts
_FAR = 1 << 60


def parse(prefix: Prefix, n: int, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boundaries of each round with the interval of words that each depends on, all ascending."""
    b = np.arange(n + 1)
    lo, hi = b.copy(), b.copy()
    lo[0], hi[-1] = -_FAR, _FAR
    out = []
    for r in range(rounds):
        if len(b) < 3:
            break
        names = prefix.of(b[:-1], b[1:])
        right = (mix(names ^ _ROUND[r]) >> np.uint64(63)).astype(bool)
        merged = (names[1:] == names[:-1]) | (~right[:-1] & right[1:])
        keep = np.flatnonzero(~merged) + 1
        lo = np.concatenate([[-_FAR], lo[keep - 1], [n]])
        hi = np.concatenate([[0], hi[keep + 1], [_FAR]])
        b = np.concatenate([[0], b[keep], [n]])
        out.append((b, lo, hi))
    return out


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place of the least of ``values[lo:hi]`` for every pair of (non-empty) bounds; equal values: the first."""
    packed = (values >> np.uint64(24) << np.uint64(24)) | np.arange(len(values), dtype=np.uint64)
    n = hi - lo
    depth = np.frexp(n.astype(float))[1] - 1  # floor of the logarithm
    out = np.zeros(len(lo), np.uint64)
    for d in range(int(depth.max()) + 1 if len(n) else 0):
        at = np.flatnonzero(depth == d)
        out[at] = np.minimum(packed[lo[at]], packed[hi[at] - (1 << d)])
        step = 1 << d
        packed = np.minimum(packed[:-step], packed[step:]) if len(packed) > step else packed[:0]
    return (out & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchored(h: np.ndarray, ok: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Units among the windows ``ok`` of a word sequence: key, content, first and last start."""
    n = len(h)
    prefix = Prefix(h)
    starts = np.flatnonzero(ok)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    place = np.full(len(starts), -1)  # boundary of the anchor; -1: the window itself is its key
    level = np.zeros(len(starts), np.int64)
    key = np.zeros(len(starts), np.uint64)
    open_ = np.arange(len(starts))
    for r, (b, lo, hi) in reversed(list(enumerate(parse(prefix, n, rounds), 1))):
        use = (hi - lo >= SHORT) & (hi - lo <= window)
        b, lo, hi = b[use], lo[use], hi[use]
        if not len(b) or not len(open_):
            continue
        p = starts[open_]
        i, j = np.searchsorted(lo, p), np.searchsorted(hi, p + window, "right")
        good = i < j
        names = mix(prefix.of(lo, hi) + (b - lo).astype(np.uint64) * _ROUND[63] + _ROUND[r])
        at, best = open_[good], least_between(names, i[good], j[good])
        place[at], level[at], key[at] = b[best], r, names[best]
        open_ = open_[~good]
    key[open_] = mix(prefix.of(starts[open_], starts[open_] + window))
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (place[1:] != place[:-1]) | (level[1:] != level[:-1]) | (place[1:] < 0)
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    shift = np.where(place[head] < 0, 0, place[head] - first)
    hull = mix(prefix.of(first, last + window) + shift.astype(np.uint64) * _ROUND[60] + (last - first).astype(np.uint64) * _ROUND[61])
    return key[head].view(np.int64), hull.view(np.int64), first, last


def word_units(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> Units:
    """Units of several texts; starts count words within their text."""
    _, _, h, bounds = words(buf, offsets)
    sizes = np.diff(bounds)
    # pieces of texts: texts of at least a window, the longer ones cut with an overlap of window - 1 words
    text, lo, hi = [], [], []
    for i in np.flatnonzero(sizes >= window):
        for s in range(0, sizes[i] - window + 1, PIECE):
            text.append(i)
            lo.append(bounds[i] + s)
            hi.append(min(bounds[i] + s + PIECE + window - 1, bounds[i + 1]))
    if not text:
        return Units(*(np.zeros(0, np.int64) for _ in range(5)))
    text, lo, hi = np.array(text), np.array(lo), np.array(hi)
    parts, at = [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(np.cumsum(hi[at:] - lo[at:]), 2 * PIECE, "right")) + at)
        n = hi[at:to] - lo[at:to]
        owner = np.repeat(np.arange(len(n)), n + 1)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)  # 0 is the mark before the piece
        seq = np.where(inside == 0, _END, h[np.minimum(lo[at:to][owner] + np.maximum(inside - 1, 0), len(h) - 1)])
        seq = np.append(seq, _END)
        ok = np.append((inside > 0) & (inside - 1 + window <= n[owner]), False)
        u, hull, first, last = anchored(seq, ok, window, rounds)
        base = lo[at:to] - bounds[text[at:to]]
        own = owner[first]
        shift = base[own] - (np.cumsum(n + 1) - (n + 1))[own] - 1
        parts.append(Units(text[at:to][own], u, hull, first + shift, last + shift))
        at = to
    return Units(*(np.concatenate(x) for x in zip(*parts)))


def repeated_word_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, k, ranges`` of word positions at which windows start whose words also start a window elsewhere."""

    def windows_of(buf: np.ndarray, u, hull, first, last, base) -> Iterator[pa.RecordBatch]:
        _, _, h, _ = words(buf, np.array([0, len(buf)]))
        prefix = Prefix(h)
        n = last - first + 1
        own = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        start = first[own] + at
        hashes = prefix.of(start, start + window)
        yield pa.RecordBatch.from_arrays([pa.array(u[own]), pa.array(hull[own]), pa.array(base[own] + at), pa.array(hashes.view(np.int64))], ["u", "hull", "at", "h"])

    def resolve(texts: DataFrame, speakers: DataFrame) -> DataFrame:
        return repeated_hashes(with_speakers(texts, speakers, windows_of, "u long, hull long, at long, h long"))

    return repeated_windows(docs, lambda b, o: word_units(b, o, window, rounds), resolve)


_BLANK = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def _kept(text: bytes, ranges: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    w = [x for x in text.translate(_BLANK).split(b" ") if x]
    if not ranges:
        return len(w), 0, b" ".join(w)
    gone = covered(ranges, len(w), window)
    return len(w), int(gone.sum()), b" ".join([x for x, g in zip(w, gone) if not g])


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Each row of ``docs(doc_id, text)``: ``n_words, n_removed, kept`` (the words that stay, joined by a space)."""

    def run(text: bytes, ranges: list[dict] | None):
        n, gone, kept = _kept(text, ranges, window)
        return n, gone, kept.decode()

    return digest(docs, repeated_word_windows(docs, window, rounds), run, "n_words long, n_removed long, kept string")


def removal_digest(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """As ``remove_repeats``, with the sha256 of the kept words for their text."""

    def run(text: bytes, ranges: list[dict] | None):
        n, gone, kept = _kept(text, ranges, window)
        return n, gone, hashlib.sha256(kept).hexdigest()

    return digest(docs, repeated_word_windows(docs, window, rounds), run, "n_words long, n_removed long, kept_sha256 string")
