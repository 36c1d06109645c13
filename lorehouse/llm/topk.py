"""Exact top-k inner products by ball trees, branch and bound, and a shared k-th score."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, in_arrow

#: Vectors of a tree and of a leaf, queries of a block, and one in so many vectors searched first.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, SEED = 32768, 256, 8192, 16


def quantise(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as longs; null if the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class BallTree:
    """Balls over the rows of one shard: centre, radius, slice of the reordered rows, children, smallest id."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray) -> None:
        order = np.arange(len(ids))
        exact = vectors.astype(np.float64)
        self.centres, self.radii, self.spans, self.children, self.least = [], [], [], [], []

        def build(lo: int, hi: int) -> int:
            rows = exact[order[lo:hi]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.centres)
            self.centres.append(centre)
            self.radii.append(away.max())
            self.spans.append((lo, hi))
            self.children.append(None)
            self.least.append(int(ids[order[lo:hi]].min()))
            if hi - lo > LEAF_ROWS and away.max() > 0:
                a = rows[away.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows @ (b - a), half)]
                self.children[node] = (build(lo, lo + half), build(lo + half, hi))
            return node

        build(0, len(ids))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.ids, self.numbers, self.vectors = ids[order], numbers[order], vectors[order]
        self._measure()

    def _measure(self) -> None:
        self.exact = self.vectors.astype(np.float64)
        self.most = float(np.abs(self.exact).max(initial=0))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        children = np.array([c or (-1, -1) for c in self.children], np.int64)
        np.savez(out, centres=self.centres, radii=self.radii, spans=np.array(self.spans, np.int64), children=children, least=np.array(self.least, np.int64), ids=self.ids, numbers=self.numbers, vectors=self.vectors)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BallTree:
        tree, held = cls.__new__(cls), np.load(io.BytesIO(raw))
        tree.centres, tree.radii, tree.ids, tree.numbers, tree.vectors = (held[c] for c in ("centres", "radii", "ids", "numbers", "vectors"))
        tree.spans, tree.least = list(map(tuple, held["spans"].tolist())), held["least"].tolist()
        tree.children = [None if c[0] < 0 else tuple(c) for c in held["children"].tolist()]
        tree._measure()
        return tree

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: list[tuple[int, int, int]], k: int, narrow: bool) -> list[tuple[int, int, int]]:
        """best holds (score, -id, -number) in a heap, the k-th best first; nodes are opened by upper bound until it can't be beaten. own is the query's number."""
        todo = [(-bounds[0], 0)]
        rows, q = (self.exact, query.astype(np.float64)) if narrow else (self.vectors, query)
        while todo:
            bound, node = heapq.heappop(todo)
            if len(best) == k and -bound < best[0][0]:
                break
            if len(best) == k and np.floor(-bound) == best[0][0] and -self.least[node] < best[0][1]:
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    if len(best) < k or bounds[child] >= best[0][0]:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            lo, hi = self.spans[node]
            scores = (rows[lo:hi] @ q).astype(np.int64)
            ids, numbers = self.ids[lo:hi], self.numbers[lo:hi]
            on = numbers != own
            if len(best) == k:
                on &= scores >= best[0][0]
            on = np.flatnonzero(on)
            if len(on) > k:
                on = on[np.lexsort((numbers[on], ids[on], -scores[on]))[:k]]
            for item in zip(scores[on].tolist(), (-ids[on]).tolist(), (-numbers[on]).tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


#: What a search gives: the query's number and id, and a candidate's.
_FOUND = "number long, query_id long, vec_id long, other long, score long"


def _trees(vectors: DataFrame) -> DataFrame:
    """dim int and tree binary: a ball tree of each SHARD_ROWS vectors of one dimension, and of the rest of a task's; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def shard(dim: int) -> pa.RecordBatch:
            tree = BallTree(*(np.concatenate(x) for x in zip(*held.pop(dim), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([tree.to_bytes()], pa.binary())], ["dim", "tree"])

        for batch in batches:
            numbers, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "vec_id"))
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                on = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[on], numbers[on], values[starts[on, None] + np.arange(dim)].reshape(len(on), dim)))
                if sum(len(a) for a, _, _ in held[dim]) >= SHARD_ROWS:
                    yield shard(dim)
        for dim in list(held):
            yield shard(dim)

    return cut(in_arrow(vectors.select("number", "vec_id", "v"), run, "dim int, tree binary"))


def _search(trees: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], floor: dict[int, list[tuple[int, int, int]]], k: int) -> DataFrame:
    """Top k of each task's trees for a block of queries; block: by dimension, numbers, ids and vectors; floor: by number, the k best known before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int, int]]] = {}  # goes on from tree to tree of the task
        names: dict[int, int] = {}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("tree"), strict=True):
                if dim not in block:
                    continue
                tree = BallTree.from_bytes(raw.as_py())
                numbers, ids, queries = block[dim]
                names.update(zip(numbers.tolist(), ids.tolist(), strict=True))
                wide = queries.astype(np.float64)
                norms = np.sqrt((wide**2).sum(axis=1))
                narrow = dim * tree.most * float(np.abs(wide).max(initial=0)) < 2.0**52
                reach = np.sqrt((tree.centres**2).sum(axis=1)) + tree.radii
                for at in range(0, len(ids), 1024):
                    upper = wide[at : at + 1024] @ tree.centres.T + norms[at : at + 1024, None] * (tree.radii + 1e-9 * reach) + 1e-6
                    for i, bounds in enumerate(upper, at):
                        q = int(numbers[i])
                        best[q] = tree.search(queries[i], q, bounds, best.get(q) or list(floor.get(q, ())), k, narrow)
        rows = [(q, names[q], -x, -n, s) for q, found in best.items() for s, x, n in found if (s, x, n) not in floor.get(q, ())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["number", "query_id", "vec_id", "other", "score"])

    return in_arrow(trees, run, _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows, ties to the smaller id.

    vectors has vec_id long and v array<long>. The trees are built once and written, those of one in SEED vectors apart.
    Queries are taken in blocks of BLOCK_ROWS, one after the other: the driver holds one block, and its results are
    written before the next. For each block the trees of the few are searched first; the k best found there go with the
    block to all others, which are left as soon as no node's bound beats the k-th score. Only vectors of equal dimension are compared. Null ids or vectors take no part; rows
    that share an id or a vector each are candidates, and queries, of their own; queries with fewer than k others get
    all; an empty table gives an empty result. A block's results are at most k rows a query.

    Returns query_id long, rank int from 1, vec_id long, score long.
    """
    rows = cut(vectors.where("vec_id is not null and v is not null").select("vec_id", "v").withColumn("number", F.monotonically_increasing_id()))  # numbers that last, once written
    queries = cut(rows.where(is_query))
    blocks = -(-queries.count() // BLOCK_ROWS)
    seed = F.pmod(F.xxhash64("number", F.lit(1)), F.lit(SEED)) == 0
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id", "other")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    some, others = _trees(rows.where(seed)), _trees(rows.where(~seed))
    found = cut(best(rows.sparkSession.createDataFrame([], _FOUND)))
    discard(rows)
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("number", F.lit(2)), F.lit(blocks)) == b).collect()
        block = {}
        for dim in {len(r["v"]) for r in mine}:
            same = [r for r in mine if len(r["v"]) == dim]
            block[dim] = (*(np.array([r[c] for r in same], np.int64) for c in ("number", "vec_id")), np.array([r["v"] for r in same], np.int64).reshape(len(same), dim))
        first = cut(best(_search(some, block, {}, k)).drop("rank"))
        floor: dict[int, list[tuple[int, int, int]]] = {}
        for r in first.collect():
            floor.setdefault(r["number"], []).append((r["score"], -r["vec_id"], -r["other"]))
        for known in floor.values():
            heapq.heapify(known)
        found = cut(best(first.union(_search(others, block, floor, k))), onto=found)
        discard(first)
    discard(queries, some, others)
    return found.select("query_id", "rank", "vec_id", "score")
