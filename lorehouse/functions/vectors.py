"""Cosine similarity as expressions, and products of blocks that keep counts or the nearest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block at least, where a side has them; blocks of a side, until one would hold more than so many components. A task holds two.
BLOCK_ROWS, SPREAD, COMPONENTS = 2048, 16, 1 << 22
#: Rows of the two sides that one step within a task multiplies.
STEP = (512, 1024)
#: Vectors of a block where only counts leave a task, and of one step within it.
COUNT_ROWS, STEP_ROWS = 8192, 512
#: Cosines a unit; the counts of -1..1 are sent in parts of so many.
UNIT, PART = 1_000_000, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clamped to -1..1; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def valid(vec: Column, dims: int) -> Column:
    """Whether a vector has dims components, all finite."""
    return vec.isNotNull() & (F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def hashed_words(content: Column, dims: int = 64) -> Column:
    """A deterministic embedding: how many of a text's words fall into each of dims buckets by MD5. It stands where a model's vectors are not at hand."""
    words = F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9]+"), F.lit(0))
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dims).cast("int"))
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dims), lambda s, b: F.transform(s, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
    return F.when(F.size(words) > 0, counts)


def similarity_counts(vectors: DataFrame, block: int = COUNT_ROWS) -> DataFrame:
    """(sim, dup, n): how many pairs of rows of vectors (id, vec, label) have a cosine, rounded to 6 places, and one label or two.

    Every pair of unlike ids counts once, whatever its cosine; dup is null where a label is. Rows are dealt into blocks
    by hash, and each two blocks are one group, which sends counts in place of pairs: 2000001 a dup at most.
    """
    size = vectors.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("nb"))
    v = vectors.join(F.broadcast(size)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))  # size is one row
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    v = v.select("id", "vec", "label", "block", F.least("block", "other").alias("lb"), F.greatest("block", "other").alias("rb"))
    parts = -(-(2 * UNIT + 1) // PART)

    def count(t: pa.Table) -> pa.Table:
        vec, codes = t["vec"].combine_chunks(), lambda c: t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        m = vec.flatten().to_numpy().reshape(t.num_rows, -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, labels, own = codes("id"), codes("label"), t["block"].to_numpy()
        one = t["lb"][0] == t["rb"][0]
        left = np.argsort(ids, kind="stable") if one else np.flatnonzero(own == t["lb"][0].as_py())
        right = left if one else np.flatnonzero(own == t["rb"][0].as_py())
        total = np.zeros(3 * parts * PART, np.int64)
        for at in range(0, len(left), STEP_ROWS):
            i, j = left[at : at + STEP_ROWS], right[at:] if one else right
            k = np.rint(np.clip(m[i] @ m[j].T, -1, 1) * UNIT).astype(np.int64) + UNIT
            a, b = labels[i][:, None], labels[j][None, :]
            k += np.where((a < 0) | (b < 0), 2, a == b) * (parts * PART)
            total += np.bincount(k[ids[i][:, None] < ids[j][None, :]] if one else k.ravel(), minlength=len(total))
        rows = total.reshape(-1, PART)
        found = np.flatnonzero(rows.any(axis=1))
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * PART), pa.array(rows[found].ravel().astype(np.int32)))
        return pa.table({"kind": pa.array((found // parts).astype(np.int32)), "part": pa.array((found % parts).astype(np.int32)), "counts": counts})

    def united(t: pa.Table) -> pa.Table:
        n = t["counts"].combine_chunks().flatten().to_numpy().reshape(-1, PART).sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(n)
        return pa.table({"sim": (t["part"][0].as_py() * PART + at - UNIT) / UNIT, "kind": pa.array(np.full(len(at), t["kind"][0].as_py(), np.int32)), "n": n[at]})

    sent = v.groupBy("lb", "rb").applyInArrow(count, "kind int, part int, counts array<int>")
    summed = sent.groupBy("kind", "part").applyInArrow(united, "sim double, kind int, n long")
    return summed.select("sim", F.when(F.col("kind") < 2, F.col("kind") == 1).alias("dup"), "n")


def blocks(rows: Column, dims: Column, block: int = BLOCK_ROWS) -> Column:
    """How many blocks a side is dealt into: SPREAD of them once it has the rows, so that each row is sent SPREAD times whatever the size, and more only where a block would be too large for a task."""
    return F.greatest(F.lit(1), F.ceil(rows * dims / COMPONENTS), F.least(F.lit(SPREAD), F.ceil(rows / block))).cast("int")


def matrix(vec: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length, as doubles."""
    parts = [p for p in (vec.chunks if isinstance(vec, pa.ChunkedArray) else [vec]) if len(p)]
    sizes = {x for p in parts for x in pc.unique(pc.list_value_length(p)).to_pylist()}
    if None in sizes or len(sizes) > 1:
        raise ValueError("vectors have to be of one dimension, and not null")
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(p), -1) for p in parts]) if parts else np.zeros((0, 0))


def units(vec: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = matrix(vec)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x and its row of y, summed component by component: it doesn't depend on where rows stand in a block, as that of a product does, so copies tie."""
    dot = lambda a, b: np.cumsum(a * b, axis=1)[:, -1]
    return np.clip(dot(x, y) / np.maximum(np.sqrt(dot(x, x) * dot(y, y)), 1e-300), -1, 1)


class Best:
    """The k nearest of the rows y met so far for each of the rows x, unit vectors both: by the cosine, rounded to 9 places, ties to the smaller id.

    Products are formed in single precision; what may be among the best by its bound of error is computed in double. With
    least, rows that are less similar than that are left out.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: pa.ChunkedArray | pa.Array, k: int, least: np.ndarray | None = None) -> None:
        self.x, self.y, self.k = x, y, min(k, len(y))
        self.x32, self.y32 = x.astype(np.float32), y.astype(np.float32)
        self.by_id = pc.sort_indices(ids).to_numpy().astype(np.int64)
        self.place = np.empty(len(y), np.int64)
        self.place[self.by_id] = np.arange(len(y))
        self.error = (x.shape[1] + 8) * 1.2e-7
        self.floor = np.full(len(x), -np.inf) if least is None else np.where(least > -1, least, -np.inf)
        self.sims, self.at = np.full((len(x), self.k), -np.inf), np.full((len(x), self.k), -1)

    def meet(self, rows: np.ndarray, columns: np.ndarray) -> None:
        """Hold rows of x against rows of y (each given once, in the order of their ids)."""
        for lo in range(0, len(rows), STEP[0]):
            for at in range(0, len(columns), STEP[1]):
                self._step(rows[lo : lo + STEP[0]], columns[at : at + STEP[1]])

    def _step(self, r: np.ndarray, c: np.ndarray) -> None:
        m, k = self.x32[r] @ self.y32[c].T, self.k
        fresh = np.isneginf(self.floor[r])
        if len(c) > k and fresh.any():
            self.floor[r[fresh]] = np.partition(m[fresh], len(c) - k, axis=1)[:, len(c) - k] - self.error - 1e-9
        i, j = np.divmod(np.flatnonzero(m >= (self.floor[r] - self.error - 1e-9).astype(np.float32)[:, None]), len(c))
        if len(i) > 16 * k * len(r) and len(c) > k:  # many copies: the first of those that tie
            s = np.round(np.clip(self.x[r] @ self.y[c].T, -1, 1), 9)
            kth = np.partition(s, len(c) - k, axis=1)[:, len(c) - k, None]
            more, same = s > kth, s == kth
            i, j = np.nonzero(more | (same & (np.cumsum(same, axis=1) <= k - more.sum(axis=1, keepdims=True))))
            s = s[i, j]
        else:
            s = np.round(np.clip(np.einsum("ij,ij->i", self.x[r[i]], self.y[c[j]]), -1, 1), 9)
        if not len(i):
            return
        met, own = np.unique(i, return_inverse=True)
        rows, n = r[met], len(met)
        own = np.concatenate([own, np.repeat(np.arange(n), k)])
        s, c = np.concatenate([s, self.sims[rows].ravel()]), np.concatenate([c[j], self.at[rows].ravel()])
        o = np.lexsort((self.place[c], -s, own))
        nth = np.arange(len(o)) - np.searchsorted(own[o], np.arange(n))[own[o]]
        o = o[nth < k]
        self.sims[rows], self.at[rows] = s[o].reshape(n, k), c[o].reshape(n, k)
        self.floor[rows] = np.maximum(self.floor[rows], self.sims[rows, k - 1] - 1e-9)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, rows of y and their cosines."""
        i, nth = np.nonzero(self.at >= 0)
        return i, self.at[i, nth], self.sims[i, nth]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, sim, place): the k rows of vectors (id, vec) nearest each query (query_id, vec), ties to the smaller id.

    Both sides are dealt into blocks by hash; a group is a pair of blocks and keeps k rows a query. Cosines are
    rounded to 9 places, so that ties don't depend on the order of sums.
    """
    size = lambda df, name: df.agg(blocks(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1)), block).alias(name))
    counts = size(queries, "nq").join(F.broadcast(size(vectors, "nv")))  # one row
    q = queries.join(F.broadcast(counts)).select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("vb"))
    v = vectors.join(F.broadcast(counts)).select("id", "vec", F.pmod(F.xxhash64("id"), F.col("nv")).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"))
    v = v.select(F.col("id").alias("v_id"), F.col("vec").alias("v_vec"), F.col("qb").alias("v_qb"), F.col("vb").alias("v_vb"))

    def top(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"query_id": x["query_id"].slice(0, 0), "id": y["v_id"].slice(0, 0), "sim": pa.array([], pa.float64())})
        best = Best(units(x["vec"]), units(y["v_vec"]), y["v_id"], k)
        best.meet(np.arange(x.num_rows), best.by_id)
        i, j, s = best.found()
        return pa.table({"query_id": x["query_id"].take(pa.array(i)), "id": y["v_id"].take(pa.array(j)), "sim": s})

    kind = queries.schema["query_id"].dataType.simpleString()
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("v_qb", "v_vb")).applyInArrow(top, f"query_id {kind}, id string, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
