"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Every tree halves the space by planes between two random sample points, down to leaves.  A query
walks all trees through one priority queue ordered by the summed margins of the planes crossed, so the
most promising leaves of any tree are opened first, until enough candidates are gathered; candidates
are reranked by their inner product in double precision on the original vectors.

The largest inner product becomes a nearest direction by one more coordinate that lifts all
vectors to the same length.  The planes are fitted on a bounded sample (``sample`` vectors), every
vector is indexed.  Equal vectors form one entry that holds their ``k + 1`` smallest ids, which is
all that any list of ``k`` neighbours can need; so a vector that a third of the rows share neither
fills a leaf nor is lost.

The k-th best score among the sample points in the leaves that a query opens bounds what it finds from
below, so a task passes on only candidates that reach it; at least ``k`` always do.  Neighbouring leaves
form a cell of about ``CELL_ROWS`` entries for one task; a leaf that holds more is split over several,
so no group of vectors grows with the table.  How much a query must look at
for a given recall depends on the data: ``share`` suits vectors without any clusters, the hardest
case; clustered vectors need far less.

Defined cases: null vectors, zero vectors and such with null or non-finite components take no
part; vectors of different lengths never meet; with fewer than ``k`` candidates all are returned;
equal scores go by id; rows that repeat an id with the same vector count once; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

TREES = 10
LEAF_SAMPLE = 60  # sample points in a leaf at most
CELL_ROWS = 8_000  # entries that one task compares at once
SAMPLE = 20_000
SHARE = 0.6  # of all entries that a query looks at, counted over all trees, while that is more than LEAST
LEAST = 8_000


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)


@dataclass
class Forest:
    normals: np.ndarray  # nodes x dimensions
    offsets: np.ndarray
    children: np.ndarray  # nodes x 2; below zero: leaf -1 - number
    roots: list[int]
    leaf_size: np.ndarray  # sample points of each leaf
    top: float  # largest length of a vector
    scale: float = 1.0  # entries for each sample point
    sample: np.ndarray | None = None  # the sample points themselves
    sample_leaf: np.ndarray | None = None  # their leaf in every tree


def lift(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top * top - (x * x).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def grow(points: np.ndarray, top: float, trees: int = TREES, leaf: int = LEAF_SAMPLE, seed: int = 17) -> Forest:
    """Trees over the (lifted) sample points."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, sizes, roots = [], [], [], [], []

    def build(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            sizes.append(len(rows))
            return -len(sizes)
        for _ in range(4):
            a, b = points[rng.choice(rows, 2, replace=False)]
            size = np.linalg.norm(a - b)
            if size == 0:
                continue
            n, cut = (a - b) / size, float((a @ a - b @ b) / (2 * size))
            side = points[rows] @ n > cut
            if 0.1 <= side.mean() <= 0.9:
                break
        else:
            n = rng.standard_normal(points.shape[1])
            n /= np.linalg.norm(n)
            at = points[rows] @ n
            cut = float(np.median(at))
            side = at > cut
            if side.all() or not side.any():
                sizes.append(len(rows))
                return -len(sizes)
        me = len(normals)
        normals.append(n)
        offsets.append(cut)
        children.append([0, 0])
        low, high = build(rows[~side]), build(rows[side])
        children[me] = [low, high]
        return me

    for _ in range(trees):
        roots.append(build(np.arange(len(points))))
    d = points.shape[1]
    return Forest(np.array(normals).reshape(-1, d), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, np.array(sizes), top)


def leaves_of(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of every (lifted) vector in every tree: vectors x trees."""
    out = np.zeros((len(x), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots):
        node = np.full(len(x), root)
        rows = np.flatnonzero(node >= 0)
        while len(rows):
            at = node[rows]
            high = np.einsum("ij,ij->i", x[rows], forest.normals[at]) > forest.offsets[at]
            node[rows] = forest.children[at, high.astype(int)]
            rows = rows[node[rows] >= 0]
        out[:, t] = -1 - node
    return out


def search(forest: Forest, q: np.ndarray, wanted: float) -> list[list[int]]:
    """Leaves to open for each (lifted) query, by one queue over all trees, until they hold ``wanted`` entries in expectation."""
    out = []
    for lo in range(0, len(q), 256):
        margins = q[lo : lo + 256] @ forest.normals.T - forest.offsets if len(forest.normals) else np.zeros((len(q[lo : lo + 256]), 0))
        for row in margins:
            heap = [(0.0, r) for r in forest.roots]
            heapq.heapify(heap)
            found, have = [], 0.0
            while heap and have < wanted:
                crossed, node = heapq.heappop(heap)
                while node >= 0:
                    m = row[node]
                    low, high = forest.children[node]
                    near, far = (high, low) if m > 0 else (low, high)
                    heapq.heappush(heap, (crossed + abs(m), int(far)))
                    node = int(near)
                found.append(-1 - node)
                have += forest.leaf_size[-1 - node] * forest.scale
            out.append(found)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _group(keys: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return {int(keys[part[0]]): part for part in np.split(order, cuts) if len(part)}


def _first(key: np.ndarray, *order: np.ndarray, n: int) -> np.ndarray:
    """Rows that are among the first ``n`` of their key, in the given order."""
    rows = np.lexsort((*order[::-1], key))
    k = key[rows]
    return rows[np.arange(len(k)) - np.searchsorted(k, k) < n]


def _bounds(x: np.ndarray, forest: Forest, opened: list[list[int]], k: int) -> np.ndarray:
    """A score that ``k`` entries in the opened leaves of each query reach for certain: the k-th best of the sample points in them, which are entries too."""
    best = np.full(len(x), -np.inf)
    scores = x @ forest.sample.T if len(forest.sample) else np.zeros((len(x), 0))
    for i, leaves in enumerate(opened):
        is_open = np.zeros(len(forest.leaf_size), bool)
        is_open[leaves] = True
        seen = scores[i, is_open[forest.sample_leaf].any(axis=1)]
        if len(seen) >= k:
            best[i] = -np.partition(-seen, k - 1)[k - 1]
    return best - 1e-9 * (1 + np.abs(best))  # sums in another order may differ in the last places


def _best(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest entries of each query within the leaves of a cell that it opens; scores summed from the first component on."""
    empty = pa.table({"qid": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not asked.num_rows or not held.num_rows:
        return empty
    q, v, bound = _matrix(asked.column("q")), _matrix(held.column("v")), asked.column("bound").to_numpy()
    in_leaf = _group(held.column("leaf").to_numpy())
    spare = k + 8
    found = []
    for leaf, qs in _group(asked.column("leaf").to_numpy()).items():
        vs = in_leaf.get(leaf)
        if vs is None:
            continue
        for lo in range(0, len(qs), 512):
            part = qs[lo : lo + 512]
            s = q[part] @ v[vs].T
            i, j = np.nonzero(s >= bound[part][:, None])
            found.append((part[i], vs[j], s[i, j]))
    if not found:
        return empty
    qi, vi, s = (np.concatenate(x) for x in zip(*found))
    qid, vid = asked.column("qid").to_numpy()[qi], held.column("vid").to_numpy()[vi]
    once = np.lexsort((vid, qid))  # an entry can come from several trees
    new = np.ones(len(once), bool)
    new[1:] = (qid[once[1:]] != qid[once[:-1]]) | (vid[once[1:]] != vid[once[:-1]])
    keep = once[new]
    keep = keep[_first(qid[keep], -s[keep], n=spare)]
    qi, vi, qid, vid = qi[keep], vi[keep], qid[keep], vid[keep]
    exact = np.concatenate([np.cumsum(q[qi[lo : lo + 4096]] * v[vi[lo : lo + 4096]], axis=1)[:, -1] for lo in range(0, len(qi), 4096)])
    keep = _first(qid, -exact, vid, n=k)
    return pa.table({"qid": qid[keep], "vid": vid[keep], "score": exact[keep]})


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, sample: int = SAMPLE, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``vectors(vec_id, embedding)``: for the rows with ``is_query``, ``query_id, rank, vec_id, score``."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q"))
    rows = cut_lineage(rows.withColumn("h", F.xxhash64("v")), "vectors")
    sizes = [r[0] for r in rows.select(F.size("v")).distinct().collect()]  # one in any sane table
    parts = [_of_one_length(rows.where(F.size("v") == d) if len(sizes) > 1 else rows, k, trees, sample, share, least) for d in sorted(sizes)]
    if not parts:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _of_one_length(rows: DataFrame, k: int, trees: int, sample: int, share: float, least: int) -> DataFrame:
    spark = rows.sparkSession
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    first = rows.select("vec_id", "h", "v").withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    entries = first.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select("h", "v", "ids", F.col("ids")[0].alias("vid"))
    asks = rows.where("q").select("h", "v").distinct()
    entries = cut_lineage(entries.join(asks.withColumn("asked", F.lit(True)), ["h", "v"], "left"), "entries")
    kind = dict(entries.dtypes)["v"]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    n, top = entries.agg(F.count("*"), F.max(length)).first()
    some = entries if n <= sample else entries.where(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1_000_000)) < int(sample / n * 1_000_000))
    points = np.array([r[0] for r in some.select("v").orderBy("vid").collect()])  # about ``sample`` vectors at most
    top = float(top) * (1 + 1e-12)
    forest = grow(lift(points, top), top, trees)
    forest.scale, forest.sample = n / max(1, len(points)), points
    forest.sample_leaf = leaves_of(forest, lift(points, top)) if len(points) else np.zeros((0, trees), np.int64)
    wanted = max(least, share * n)
    shared = spark.sparkContext.broadcast(forest)  # about trees * sample / LEAF_SAMPLE planes
    expected = forest.leaf_size * forest.scale
    chunks = np.maximum(1, np.ceil(expected / CELL_ROWS)).astype(np.int64)
    cells = np.floor(np.cumsum(expected) / CELL_ROWS).astype(np.int64)  # leaves are numbered along each tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = leaves_of(shared.value, lift(_matrix(batch.column(1)), shared.value.top))
            ids = np.repeat(batch.column(0).to_numpy(), leaf.shape[1])
            flat = leaf.reshape(-1)
            at = pa.array(np.repeat(np.arange(batch.num_rows), leaf.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cells[flat]), pa.array(ids % chunks[flat]), pa.array(flat), pa.array(ids), batch.column(1).take(at)], ["cell", "chunk", "leaf", "vid", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = _matrix(part.column(1))
                ask = np.hstack([x, np.zeros((len(x), 1))])
                found = search(shared.value, ask, wanted)
                bound = _bounds(x, shared.value, found, k + 1)
                leaf = np.array([f for fs in found for f in fs], np.int64)
                own = np.repeat(np.arange(len(found)), [len(f) for f in found])
                times = chunks[leaf]
                own, leaf_ = np.repeat(own, times), np.repeat(leaf, times)
                chunk = np.arange(len(leaf_)) - np.repeat(np.cumsum(times) - times, times)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(cells[leaf_]), pa.array(chunk), pa.array(leaf_), part.column(0).take(at), part.column(1).take(at), pa.array(bound[own])], ["cell", "chunk", "leaf", "qid", "q", "bound"])

    index = entries.select("vid", "v").mapInArrow(place, f"cell long, chunk long, leaf long, vid long, v {kind}")
    probes = entries.where("asked").select("vid", "v").mapInArrow(probe, f"cell long, chunk long, leaf long, qid long, q {kind}, bound double")
    near = probes.groupBy("cell", "chunk").cogroup(index.groupBy("cell", "chunk")).applyInArrow(lambda a, h: _best(a, h, k + 1), "qid long, vid long, score double")
    near = near.groupBy("qid", "vid").agg(F.max("score").alias("score"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))).where(F.col("r") <= k + 1)
    lists = best.join(entries.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    answers = lists.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    queries = rows.where("q").select("vec_id", "h", "v").join(entries.select("h", "v", "vid"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid")).distinct()
    out = queries.join(answers, "qid").withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return out.select("query_id", F.posexplode("near").alias("p", "n")).select("query_id", (F.col("p") + 1).alias("rank"), "n.vec_id", "n.score")
