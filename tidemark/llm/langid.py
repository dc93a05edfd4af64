"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every (language, bucket) are summed by Spark; the matrix of log probabilities has a
fixed size (buckets x languages) and is broadcast; texts are scored in numpy, batch by batch, by
summing the rows of the n-grams that occur.  The language is the one of the largest posterior over
all n-grams; neighbouring n-grams overlap, so the score is the posterior with the evidence tempered.

At most about ``max_docs`` labelled texts are read for the counts: rare languages whole, frequent
ones up to one bound for all.  The priors come from all labelled rows.

Defined cases: a null text, an empty text or one without a letter is ``und`` with score 0; ties
go to the language first by code point; with no labelled row everything is ``und``; rows that
repeat are scored alike; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
SIZES = (2, 3)
TEMPER = 40.0  # n-grams that the evidence of a text counts as at most in the score
PIECE = 1 << 19  # code points that one numpy pass works on


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(points: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h = (h ^ points[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h & np.uint32(buckets - 1)).astype(np.int64)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in consecutive pieces."""
    yield text[:size]
    for at in range(size, len(text), size):
        yield text[at : at + size]


def bucket_counts(text: str, sizes=SIZES, buckets: int = BUCKETS) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    tail = ""
    for piece in pieces(text.lower()):
        for size in sizes:
            joined = tail[len(tail) - min(len(tail), size - 1) :] + piece
            total += np.bincount(grams(code_points(joined), size, buckets), minlength=buckets)
        tail = piece[-(max(sizes) - 1) :] if max(sizes) > 1 else ""
    return total


def bound_of(sizes: list[int], total: int) -> float:
    """The bound that, put on every size, makes their sum at most ``total``."""
    left, bound = total, float(total)
    for k, size in enumerate(sorted(sizes)):
        bound = left / (len(sizes) - k)
        if size > bound:
            break
        left -= size
    return bound


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets, float32
    prior: np.ndarray
    sizes: tuple[int, ...]


def fit(labelled: DataFrame, max_docs: int = 20_000, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS, smooth: float = 0.5) -> Model:
    """Learn from ``labelled(text, lang)``; of more than ``max_docs`` rows a hash sample of about that many, by language."""
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    known: dict[str, int] = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if sum(known.values()) > max_docs:
        shares = {lang: min(1.0, bound_of(list(known.values()), max_docs) / n) for lang, n in known.items()}
        share = F.create_map(*[F.lit(x) for lang, s in shares.items() for x in (lang, int(s * 1_000_000))])
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have.setdefault(lang, np.zeros(buckets, np.int64))
                have[lang] += bucket_counts(text, sizes, buckets)
        for lang, c in have.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    # at most buckets x languages rows reach the driver
    found: pd.DataFrame = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(known)
    matrix = np.full((len(languages), buckets), smooth)
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        matrix[i, own["bucket"]] += own["n"]
    prior = np.array([known[lang] for lang in languages], float)
    log_p = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32) if languages else matrix.astype(np.float32)
    return Model(languages, log_p, np.log(prior / max(1.0, prior.sum())) if languages else prior, tuple(sizes))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    out, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text or not model.languages or not any(map(str.isalpha, text)):
            out.append(UNKNOWN)
            continue
        total, n, tail = np.zeros(len(model.languages)), 0, ""
        for piece in pieces(text.lower()):
            for size in model.sizes:
                at = grams(code_points(tail[len(tail) - min(len(tail), size - 1) :] + piece), size, model.log_p.shape[1])
                n += len(at)
                if len(at):
                    total += [row.take(at).sum(dtype=np.float64) for row in model.log_p]
            tail = piece[-(max(model.sizes) - 1) :] if max(model.sizes) > 1 else ""
        best = int(np.argmax(total + model.prior))
        evidence = total * min(1.0, TEMPER / max(1, n)) + model.prior
        p = np.exp(evidence - evidence.max())
        out.append(model.languages[best])
        scores[i] = p[best] / p.sum()
    return out, scores


def identify(docs: DataFrame, model: Model, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """``docs(text, …)`` with ``lang_pred`` and ``score``; ``keep`` names the columns carried along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep, F.col("text").alias("__text"))
    names = chosen.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(shared.value, batch.column(len(names)).to_pylist())
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return chosen.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is recognised with a score of at least ``least``."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return identify(docs, model, [row]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
