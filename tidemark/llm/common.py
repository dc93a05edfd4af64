"""Shared helpers: tables, text buffers and 64-bit hashing in numpy.

Every operator first selects the columns it needs, so further columns, also such with
clashing names, never reach a join.  Rows are identified by ``(doc_id, k1)`` with ``k1`` a
hash of the text: rows that repeat both are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
SUB_BATCH = 1 << 20  # bytes of text that one numpy pass works on
LONG = 4 << 20  # a longer text is taken apart between words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(seed))


def powers(n: int, base: int = int(BASE)) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[int, np.ndarray] = {}


def cached_powers(n: int, base: int = int(BASE)) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _POW[base] = powers(max(n, 1 << 12), base)
    return have[:n]


INVERSE = pow(int(BASE), -1, 1 << 64)


class Prefix:
    """Hashes of any slice of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * cached_powers(n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = cached_powers(n + 1, INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + at)[at:]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SUB_BATCH) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_BYTE = seeded(256, 11)
_BYTE[_SEP] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: start, end, hash, and first word of each text.

    ``lower`` folds A-Z for the hash only.
    """
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if n > LONG:
        parts = []
        for lo, hi in _between_words(buf):
            s, e, h, _ = _words(buf[lo:hi], np.clip(offsets - lo, 0, hi - lo), lower)
            parts.append((s + lo, e + lo, h))
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
        return starts, ends, hashes, np.searchsorted(starts, offsets)
    return _words(buf, offsets, lower)


def _between_words(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in pieces that end before a separator (or with the text)."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(n, lo + LONG)
        while hi < n and not _SEP[buf[hi]]:
            gap = np.flatnonzero(_SEP[buf[hi : hi + LONG]])
            hi = min(n, hi + (int(gap[0]) if len(gap) else LONG))
        yield lo, hi
        lo = hi


def _words(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    inside = ~_SEP[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    first = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return starts, ends, np.zeros(0, np.uint64), first
    spans = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, spans)
    src = buf[starts[0] :]
    src = _LOWER[src] if lower else src
    longest = int((ends - starts).max())
    inside = inside[starts[0] :]
    place[~inside] = 0
    h = np.add.reduceat(_BYTE[src] * cached_powers(longest + 1)[place], starts - starts[0], dtype=np.uint64)
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * BASE), first
