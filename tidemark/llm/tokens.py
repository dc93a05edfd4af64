"""Token-id output: bit-plane shuffled, zstandard-compressed blocks with a chunk index.

Format: a Parquet folder without a codec of its own.  A row is a *chunk* of whole documents
in ascending id order:

``shard, chunk``                 place in the global order
``doc_ids, doc_tokens``          the documents of the chunk and their id counts
``block_ids, block_width``       ids in each fixed-size block and the planes kept for each id
``plane_bytes, payload``         compressed size of every plane; the planes one after another

A block of up to ``BLOCK`` ids is transposed into planes: byte planes (all lowest bytes, then
all second bytes, …) or bit planes; planes above the largest id of the block are left out.

Defined cases: a null text is empty and gives the end id alone; rows that repeat an id stay
separate rows, ordered by text; a null id sorts first; an empty table gives an empty result; a
document of any length stays whole in one chunk of many blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, cached_powers, mix, seeded, slices
from tidemark.session import shared_dir

END_ID = 2
CHUNK = 1 << 18  # ids gathered into one chunk, unless one document has more
BLOCK = 1 << 16  # ids shuffled together
CACHE = 1_000_000  # parts of texts whose ids a worker remembers
CACHE_IDS = 6 * CACHE  # ids that it remembers for them
BATCH = 1 << 20  # bytes of text encoded together

OPENS = ("\u0120", "\u010a")  # how byte-level vocabularies write a space and a line end

CHUNKS = (
    "shard long, chunk long, doc_ids array<long>, doc_tokens array<long>, block_ids array<int>, "
    "block_width array<int>, plane_bytes array<int>, payload binary"
)
_AWKWARD = re.compile(r"\s[ \n]")
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_BYTE = seeded(256, 808)


class Encoder:
    """Ids of whole texts by the tokenizer file at ``path``.

    In this kind of tokenizer a space or line end that follows something else always begins a new
    piece, and pieces are encoded apart.  So texts are cut there; the distinct parts of a batch are
    found by 64-bit hashes, the ids of each are looked up or learned once, and the ids of all parts
    are gathered.  What is known lies in plain arrays, sorted by hash, because a worker keeps it
    as long as it lives.  Texts for which that does not hold go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer is not None else b""
        spec = spec.replace(b" ", b"")
        self.by_parts = self.tokenizer.normalizer is None and all(x in spec for x in (b'"ByteLevel"', b'"use_regex":true', b'"add_prefix_space":false'))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(OPENS)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of parts, ascending; where the ids of each lie:
        self.flat, self.start, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_parts or _AWKWARD.search(t) or any(s in t for s in self.special)]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._by_parts([texts[i].encode() for i in rest])):
            out[i] = ids
        return out

    def _by_parts(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        if not len(buf):
            return [np.zeros(0, "<u4")] * len(texts)
        cut = (buf == 32) | (buf == 10)
        over = np.append(cut[1:], True)  # what is followed by a space, a line end or the end of a text
        over[bounds[1:][sizes > 0] - 1] = True
        mark = _MARK[buf] & over
        mark[1:] &= _LETTER[buf[:-1]]
        cut |= mark  # a mark between a letter and such an end is a piece of its own
        cut[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        place = np.arange(len(buf)) - np.repeat(starts, ends - starts)
        h = np.add.reduceat(_BYTE[buf] * cached_powers(int((ends - starts).max()))[place], starts, dtype=np.uint64)
        h = mix(h + (ends - starts).astype(np.uint64) * BASE)
        distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > CACHE or len(self.flat) > CACHE_IDS:
            self._forget()
        have = np.zeros(len(distinct), bool)
        if len(self.known):
            have = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] == distinct
        missing = np.flatnonzero(~have)
        if len(missing):
            self._learn(distinct[missing], [raw[a:b].decode() for a, b in zip(starts[one[missing]].tolist(), ends[one[missing]].tolist())])
        part = np.searchsorted(self.known, distinct)[which]
        counts = self.count[part]
        upto = np.cumsum(counts)
        out = self.flat[np.arange(upto[-1]) + np.repeat(self.start[part] - (upto - counts), counts)]
        edges = np.concatenate([[0], upto])[np.searchsorted(starts, bounds)]
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Add the ids of parts, whose hashes ascend.  Many that begin with a space or line end are encoded as one text, which is cut where one begins a token."""
        start, count = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        plain = [i for i, x in enumerate(parts) if x[0] in " \n" and not x[-1].isspace()]
        rest = sorted(set(range(len(parts))).difference(plain))
        flats, size = [self.flat], len(self.flat)
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = self._ids(["".join([parts[i] for i in some])])[0]
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(some):
                rest += some
                continue
            start[some], count[some] = size + cuts, np.diff(np.append(cuts, len(ids)))
            flats.append(ids)
            size += len(ids)
        for i, ids in zip(rest, self._ids([parts[i] for i in rest])):
            start[i], count[i] = size, len(ids)
            flats.append(ids)
            size += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.count = np.insert(self.known, at, hashes), np.insert(self.start, at, start), np.insert(self.count, at, count)
        self.flat = np.concatenate(flats)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def planes_of(ids: np.ndarray, bits: bool) -> tuple[int, list[bytes]]:
    """Planes of one block, lowest first, and how many each id has."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, (top.bit_length() + 7) // 8)
    if not bits:
        return width, [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    width = max(1, top.bit_length())
    all_bits = np.unpackbits(raw, axis=1, bitorder="little")
    return width, [np.packbits(all_bits[:, k], bitorder="little").tobytes() for k in range(width)]


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of one block from its planes."""
    if bits:
        flat = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        raw[:, k] = np.frombuffer(p, np.uint8)
    return raw.reshape(-1).view("<u4")


def pack(ids: np.ndarray, bits: bool, level: int) -> dict:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    block_ids, widths, sizes, payload = [], [], [], []
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        width, planes = planes_of(part, bits)
        packed = [press.compress(p) for p in planes]
        block_ids.append(len(part))
        widths.append(width)
        sizes += [len(p) for p in packed]
        payload += packed
    return {"block_ids": block_ids, "block_width": widths, "plane_bytes": sizes, "payload": b"".join(payload)}


def unpack(row: dict, bits: bool) -> np.ndarray:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    out, at, k, payload = [np.zeros(0, "<u4")], 0, 0, memoryview(row["payload"])
    for n, width in zip(row["block_ids"], row["block_width"]):
        planes = []
        for size in row["plane_bytes"][k : k + width]:
            planes.append(open_.decompress(payload[at : at + size]))
            at += size
        k += width
        out.append(ids_of(planes, n, bits))
    return np.concatenate(out)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, bits: bool = False, level: int = 3) -> None:
    """Encode every text of ``docs(doc_id, text)`` and write the ids in ascending ``doc_id`` order."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        schema = pa.schema([(n, {"l": pa.int64(), "al": pa.list_(pa.int64()), "ai": pa.list_(pa.int32()), "b": pa.binary()}[k]) for n, k in (("shard", "l"), ("chunk", "l"), ("doc_ids", "al"), ("doc_tokens", "al"), ("block_ids", "ai"), ("block_width", "ai"), ("plane_bytes", "ai"), ("payload", "b"))])
        end = np.asarray([end_id], "<u4")
        enc, number = encoder(tokenizer), 0
        doc_ids: list = []
        tokens: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            row = {"shard": shard, "chunk": number, "doc_ids": doc_ids, "doc_tokens": tokens, **pack(np.concatenate(held), bits, level)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
            for lo, hi in slices(offsets, BATCH):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                for key, ids in zip(keys[lo:hi], enc.encode(texts)):
                    doc_ids.append(key)
                    tokens.append(len(ids) + 1)
                    held += (ids, end)
                    size += tokens[-1]
                    if size >= CHUNK:
                        yield flush()
                        number, size = number + 1, 0
                        doc_ids, tokens, held = [], [], []
        if doc_ids:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(chunks, CHUNKS).write.option("compression", "none").parquet(path)


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def read_tokens(spark: SparkSession, path: str, bits: bool = False, with_ids: bool = False) -> DataFrame:
    """One row for each document of the written files: id, place, number of ids, their crc32, and the ids if wanted.

    Counts in earlier shards come from the index columns alone; within a shard a running sum follows the order written.
    """
    kinds = "shard long, chunk long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(row, bits)
                ends = np.cumsum(np.asarray(row["doc_tokens"], np.int64))
                begins = ends - np.asarray(row["doc_tokens"], np.int64)
                n = len(ends)
                out = [
                    pa.array([row["shard"]] * n, pa.int64()),
                    pa.array([row["chunk"]] * n, pa.int64()),
                    pa.array(np.arange(n)),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - begins),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in kinds.split(", ")])

    chunks = open_tokens(spark, path)
    docs = chunks.mapInArrow(rows, kinds)
    # one row for each writing task, so this order of shards is small
    totals = chunks.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("chunk", "place").rowsBetween(Window.unboundedPreceding, 0))
    return (
        docs.withColumn("start", inside - F.col("n_tokens"))
        .join(before, "shard")
        .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID, bits: bool = False, path: str | None = None) -> DataFrame:
    """Write the files (by default into the shared folder) and describe every document as read back from them."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-ids")
    write_tokens(docs, path, tokenizer, end_id, bits)
    return read_tokens(spark, path, bits)
