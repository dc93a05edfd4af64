"""The prefix trie of all conversations, from padded matrices of turn ids.

A turn is named by a 128-bit digest of role and text, so a conversation is a short row of ids beside
the byte lengths of its texts; no text is shuffled.  Rows are dealt out by ranges of their whole id
sequence (then conv_id, so that a crowd of equal conversations is split as well).  A task lays its
rows out as padded matrices of ``WIDTH`` turns at a time, holding only the rows that are that long,
sorts them with ``lexsort``, marks where a row differs from the one above in any column so far, and
sums every depth between the marks with ``reduceat``.

A node that holds neither the first nor the last row of its shard is complete.  The others, one path
at either end of a shard, go on as parts: Spark adds them up by the digest of their prefix, and one
numpy pass over the sums (two paths a shard) adds what hangs below each of them.

Defined cases: rows without conv_id belong to no conversation; null role and text are empty; turns
are ordered with null first, equal turn numbers by their digest; an empty table has no node.  One
conversation must fit into a task as ids (20 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

WIDTH = 16  # turns laid out at a time
SHARD_TURNS = 200_000  # turns in one shard, about
PIECE = 1_000  # conversation ids in one piece of a list that crosses shards
FEW_EDGES = 1_000_000  # nodes at shard ends that are sent to every task at most

NODE, EDGE, ENDS = 0, 1, 2
PARTS = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, n_bytes long, ends string"
)
EDGES = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of conversations: 16 bytes a turn, and the byte length of each turn's text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("h"), F.octet_length(text).alias("n"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "n"))).alias("turns"))


def as_rows(conversations: DataFrame) -> DataFrame:
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["h"]), ""))
    return conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n"]).alias("sizes"))


def spliced(conversations: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """Each conversation ``c`` with its first ``crc32(c) % most`` turns taken from conversation ``c - c % block``."""
    named = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    heads = named.where("conv_id = base").select("base", F.col("turns").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    none = F.array().cast(named.schema["turns"].dataType)
    return named.join(heads, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))


class Shard:
    """The rows of one shard as ragged columns."""

    def __init__(self, conv: np.ndarray, hi: np.ndarray, lo: np.ndarray, sizes: np.ndarray, at: np.ndarray):
        self.conv, self.hi, self.lo, self.sizes = conv, hi, lo, sizes
        self.start, self.length = at[:-1], np.diff(at)
        order = self._order()
        self.conv, self.start, self.length = self.conv[order], self.start[order], self.length[order]

    def matrix(self, rows: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``WIDTH`` columns, padded with 0, and where there is an id: ``[row, column]``."""
        there = self.length[rows, None] > column + np.arange(WIDTH)
        at = (self.start[rows, None] + column + np.arange(WIDTH))[there]
        ids = np.zeros((len(rows), WIDTH, 2), np.uint64)
        ids[there, 0], ids[there, 1] = self.hi[at], self.lo[at]
        return ids, there

    def _order(self) -> np.ndarray:
        rank = np.zeros(len(self.conv), np.int64)
        for column in range(0, int(self.length.max(initial=0)), WIDTH):
            rows = np.flatnonzero(self.length > column)
            ids, there = self.matrix(rows, column)
            keys = [there.sum(axis=1), *(ids[:, j, half] for j in reversed(range(WIDTH)) for half in (1, 0)), rank[rows]]
            below = np.zeros(len(rank), np.int64)
            below[rows] = 1 + _dense(keys)
            rank = _dense([below, rank])
        return np.lexsort((self.conv, rank))


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks without gaps by several keys, the last one first."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order].view(np.int64)) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Depth:
    """All nodes of one depth in the order of their rows."""

    def __init__(self, s: Shard, depth: int, rows: np.ndarray, begins: np.ndarray, parent: np.ndarray):
        self.depth, self.parent = depth, parent
        self.first = rows[begins]
        self.n = np.diff(np.append(begins, len(rows)))
        self.conv = np.minimum.reduceat(s.conv[rows], begins)
        self.ends = np.add.reduceat((s.length[rows] == depth).astype(np.int64), begins)  # the shortest rows come first
        self.bytes = s.sizes[s.start[self.first] + depth - 1].astype(np.int64) if depth else np.zeros(1, np.int64)
        self.edge = np.zeros(len(begins), bool)
        self.edge[0] = s.length[0] >= depth
        self.edge[-1] |= s.length[-1] >= depth
        self.children, self.leaves, self.saved = (np.zeros(len(begins), np.int64) for _ in range(3))


def depths(s: Shard) -> list[Depth]:
    node = np.zeros(len(s.conv), np.int64)  # of each row, at the depth reached
    out = [Depth(s, 0, np.arange(len(node)), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for column in range(0, int(s.length.max()), WIDTH):
        rows = np.flatnonzero(s.length > column)
        ids, there = s.matrix(rows, column)
        new = np.ones((len(rows), WIDTH + 1), bool)
        new[1:, 0] = np.diff(node[rows]) != 0
        new[1:, 1:] = (ids[1:] != ids[:-1]).any(axis=2) | (there[1:] != there[:-1])
        new = np.logical_or.accumulate(new, axis=1)[:, 1:]
        for j in range(min(WIDTH, int(s.length.max()) - column)):
            mine, mark = rows[there[:, j]], new[there[:, j], j]
            begins = np.flatnonzero(mark)
            out.append(Depth(s, column + j + 1, mine, begins, node[mine[begins]]))
            node[mine] = np.cumsum(mark) - 1
    for above, here in zip(reversed(out[:-1]), reversed(out[1:])):
        _finish(here)
        inner = ~here.edge
        for name, value in (("children", inner.astype(np.int64)), ("leaves", here.leaves), ("saved", here.saved)):
            np.add.at(getattr(above, name), here.parent[inner], value[inner])
    _finish(out[0])
    return out


def _finish(d: Depth) -> None:
    """What a complete node adds itself; nodes at the ends of a shard get it when they are joined."""
    inner = ~d.edge
    d.leaves[inner & (d.children == 0)] = 1
    d.saved[inner] += ((d.n - 1) * d.bytes)[inner]


def _digests(s: Shard, row: int) -> list[bytes]:
    """A key for each prefix of a row, the empty one included."""
    at = slice(s.start[row], s.start[row] + s.length[row])
    ids = np.stack([s.hi[at], s.lo[at]], axis=1).tobytes()
    digest, out = hashlib.md5(usedforsecurity=False), []
    for i in range(0, len(ids) + 1, 16):
        out.append(digest.digest())
        digest.update(ids[i : i + 16])
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Shard | None:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    t = pa.Table.from_batches(parts).combine_chunks()
    conv = t["conv_id"].to_numpy()
    ids = np.frombuffer(b"".join(t["path"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    sizes = t["sizes"].combine_chunks()
    sizes = sizes.chunk(0) if isinstance(sizes, pa.ChunkedArray) else sizes
    at = sizes.offsets.to_numpy().astype(np.int64)
    return Shard(conv, np.ascontiguousarray(ids[:, 0]), np.ascontiguousarray(ids[:, 1]), sizes.values.to_numpy(), at)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of a shard, complete ones and parts."""
    s = _read(batches)
    if s is None:
        return
    top, bottom = _digests(s, 0), _digests(s, len(s.conv) - 1)
    none = hashlib.sha256(b"").hexdigest()
    above: Depth | None = None
    for d in depths(s):
        n = len(d.n)
        keys: list[bytes | None] = [None] * n
        if d.edge[0] and s.length[0] >= d.depth:
            keys[0] = top[d.depth]
        if s.length[-1] >= d.depth:
            keys[-1] = bottom[d.depth]
        up: list[bytes | None] = [None] * n
        parent_conv = np.zeros(n, np.int64)
        loose = np.ones(n, bool)
        if above is not None:
            loose = above.edge[d.parent]
            parent_conv = above.conv[d.parent]
            for i in np.flatnonzero(loose):
                up[i] = top[d.depth - 1] if d.parent[i] == 0 and s.length[0] >= d.depth - 1 else bottom[d.depth - 1]
        lists: list[str | None] = [none] * n
        pieces: list[tuple[bytes, int, str]] = []
        for i in np.flatnonzero(d.ends):
            ids = s.conv[d.first[i] : d.first[i] + d.ends[i]]
            if d.edge[i]:
                pieces += [(keys[i], int(ids[j]), ",".join(map(str, ids[j : j + PIECE]))) for j in range(0, len(ids), PIECE)]
            else:
                lists[i] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        whole = pa.array(d.edge.astype(np.int32))  # NODE or EDGE
        yield pa.RecordBatch.from_arrays([
            whole, pa.array(keys, pa.binary()), pa.array(up, pa.binary()), pa.array(d.conv), pa.array(np.full(n, d.depth, np.int64)),
            pa.array(parent_conv, mask=loose), pa.array(d.n), pa.array(d.children), pa.array(d.leaves), pa.array(d.saved), pa.array(d.bytes), pa.array(lists, pa.string()),
        ], schema=_PARTS)
        if pieces:
            m = len(pieces)
            gap = pa.nulls(m, pa.int64())
            key, first, text = zip(*pieces)
            yield pa.RecordBatch.from_arrays([pa.array([ENDS] * m, pa.int32()), pa.array(key, pa.binary()), pa.nulls(m, pa.binary()), pa.array(first, pa.int64()), *[gap] * 7, pa.array(text, pa.string())], schema=_PARTS)
        above = d


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


_PARTS, _EDGES = _schema(PARTS), _schema(EDGES)


def _recombine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that cross shards, with what hangs below them."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).sort_by("depth")
    keys, up = t["key"].to_pylist(), t["parent_key"].to_pylist()
    place = {k: i for i, k in enumerate(keys)}
    parent = np.array([place[k] if k is not None else -1 for k in up])
    conv, depth, n, children, leaves, saved, size = (t[c].to_numpy().copy() for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_bytes"))
    np.add.at(children, parent[parent >= 0], 1)
    leaves[children == 0] += 1
    saved += (n - 1) * size
    for d in range(int(depth[-1]), 0, -1):
        here = slice(*np.searchsorted(depth, [d, d + 1]))
        np.add.at(leaves, parent[here], leaves[here])
        np.add.at(saved, parent[here], saved[here])
    columns = [pa.array(keys, pa.binary()), pa.array(conv), pa.array(depth), pa.array(conv[parent], mask=parent < 0), *(pa.array(x) for x in (n, children, leaves, saved))]
    yield pa.RecordBatch.from_arrays(columns, schema=_EDGES)


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for the pieces of each list, which come in order."""
    now, digest = None, hashlib.sha256()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != now:
                if now is not None:
                    yield told()
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if now is not None:
        yield told()


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of ``conversations(conv_id, turns)``: the columns of ``COLUMNS``."""
    rows = cut_lineage(as_rows(conversations), "paths")
    turns = rows.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    found = cut_lineage(rows.repartitionByRange(shards, "path", "conv_id").mapInArrow(_shard, PARTS), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edges = found.where(F.col("kind") == EDGE).groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("n_bytes").alias("n_bytes"))
    edges = cut_lineage(edges.repartition(1).mapInArrow(_recombine, EDGES), "edges")  # two paths a shard
    lists = found.where(F.col("kind") == ENDS).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    lists = lists.select("key", "ends").mapInArrow(_digest_lists, "key binary, ends_sha256 string")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    crossing = edges.join(lists, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(COLUMNS)

    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    if above.count() <= FEW_EDGES:
        above = F.broadcast(above)
    whole = found.where(F.col("kind") == NODE).join(above, "parent_key", "left")
    whole = whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).withColumn("ends_sha256", F.col("ends")).select(COLUMNS)
    return whole.unionByName(crossing)
