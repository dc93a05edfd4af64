"""Quality scores by Bradley-Terry pairwise ranking.

A pair of a good and a bad document is a preference; the probability that the good one wins is
the logistic function of the difference of their scores, and a score is linear in features of the
text.  The features describe form, not words: how often each class of character follows each
other, how words and lines repeat, and how long they are.  The threshold is the quantile of the
training scores below which bad documents are expected.

Defined cases: null and empty texts have the features of an empty text and so get a score too;
without labels of both kinds every score is 0.5; repeated rows score alike; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SUB_BATCH, slices, text_buffer, words

CLASSES = 24
PAIRS = CLASSES * CLASSES
EXTRA = 8
DIMENSIONS = PAIRS + EXTRA


def _classes() -> np.ndarray:
    """Class of each byte: space, line end, control, letters by case, digit, other bytes of UTF-8, and punctuation."""
    out = np.zeros(256, np.int64)
    out[:32] = 1
    out[[10, 13]] = 2
    out[48:58] = 3
    out[65:91] = 4
    out[97:123] = 5
    out[128:192] = 6
    out[192:] = 7
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    own = ".,!?|*%#$&"  # frequent ones have a class each, the others share the rest
    for c in marks:
        out[c] = 8 + own.index(chr(c)) if chr(c) in own else 8 + len(own) + c % (CLASSES - 8 - len(own))
    return out


_CLASS = _classes()


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text of a buffer."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, DIMENSIONS), np.float32)
    if n == 0:
        return out
    counts = np.zeros(n * PAIRS, np.int64)
    for at in range(0, len(buf), SUB_BATCH):  # a very long text comes in pieces that share one byte
        kind = _CLASS[buf[at : at + SUB_BATCH + 1]]
        row = np.searchsorted(offsets, np.arange(at, at + len(kind)), "right") - 1
        cell = row[:-1] * PAIRS + kind[:-1] * CLASSES + kind[1:]
        counts += np.bincount(cell[row[:-1] == row[1:]], minlength=n * PAIRS)
    out[:, :PAIRS] = np.sqrt(counts.reshape(n, PAIRS) / np.maximum(1, sizes - 1)[:, None])
    starts, ends, hashes, first = words(buf, offsets)
    for i in range(n):
        a, b = first[i], first[i + 1]
        text = buf[offsets[i] : offsets[i + 1]]
        lines = text.tobytes().split(b"\n")
        w = b - a
        lens = ends[a:b] - starts[a:b]
        out[i, PAIRS:] = (
            np.log1p(len(text)) / 10,
            np.log1p(w) / 10,
            len(np.unique(hashes[a:b])) / w if w else 0,
            lens.mean() / 10 if w else 0,
            lens.std() / 10 if w else 0,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(text) / len(lines)) / 10,
            float(w == 0),
        )
    return out


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    threshold: float
    scale: float


def train(x: np.ndarray, y: np.ndarray, pairs: int = 20_000, rounds: int = 300, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit the weights by full-batch descent with momentum on the logistic loss of the differences."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 0.02
    z = ((x - centre) / spread).astype(np.float32)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    diff = z[i] - z[j]
    w = np.zeros(x.shape[1], np.float32)
    step, m, v = 0.02, np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(p @ diff) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    # the quantile of scores that leaves the fewest training documents on the wrong side
    order = np.argsort(s, kind="stable")
    wrong = np.cumsum(np.where(y[order] == 1, 1, 0)) + (len(bad) - np.cumsum(np.where(y[order] == 0, 1, 0)))
    best = int(np.argmin(wrong))
    below, above = s[order[best]], s[order[min(best + 1, len(order) - 1)]]
    return Model((w / spread).astype(np.float64), centre.astype(np.float64), float((below + above) / 2), float(max(1e-6, s.std() / 2)))


def fit(labelled: DataFrame) -> Model:
    """Learn from ``labelled(text, quality)``, which the caller bounds (``bounded_sample``); only the features reach the driver."""
    rows = labelled.select("text", "quality").where("quality IN (0, 1)")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.concatenate([x for x in _rows(batch.column(0))] or [np.zeros((0, DIMENSIONS), np.float32)])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in f], pa.binary()), batch.column(1).cast(pa.int32())], ["f", "y"])

    got = rows.mapInArrow(vectors, "f binary, y int").toPandas()
    got = got.sort_values(["y", "f"])  # the order of arrival must not matter
    x = np.frombuffer(b"".join(got["f"]), np.float32).reshape(-1, DIMENSIONS)
    return train(x, got["y"].to_numpy(np.int64))


def bounded_sample(labels: DataFrame, max_docs: int) -> DataFrame:
    """About ``max_docs`` of the labels ``(doc_id, quality)`` by a hash of the id, all if there are fewer; several labels of one id count as their majority, 1 on a tie."""
    rows = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    n = rows.count()
    if n <= max_docs:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(max_docs / n * 1_000_000))


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    buf, offsets = text_buffer(column)
    for i, j in slices(offsets):
        yield features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def score(docs: DataFrame, model: Model, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``docs(text, …)`` with ``score`` in 0..1; 0.5 is the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep, F.col("text").alias("__text"))
    names = chosen.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = [((f - m.centre) @ m.weights - m.threshold) / m.scale for f in _rows(batch.column(len(names)))]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(s) if s else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(p)], [*names, "score"])

    return chosen.mapInArrow(run, f"{schema}, score double")
