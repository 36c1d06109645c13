"""The exact similarity join: vectors meet only where their angles to common pivots let a pair reach the threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import cut

#: Rows of a group's side at least, where a side has them (vectors.SPREAD and COMPONENTS say when it is more), pivots at most, and rows that they are chosen from, by pivot.
BLOCK_ROWS, PIVOTS, SAMPLED = 2048, 1024, 8
#: Rows of the two sides that one step within a task multiplies, and rows of a batch that are dealt at once.
STEP, DEALT = (1024, 4096), 1024
#: Angles give way by so much, as they are rounded.
SLACK = 1e-6


@dataclass
class Pivots:
    """Unit vectors in an order in which near ones stand together, the group of each, and the largest angle to it of the rows that are nearest to it."""

    vectors: np.ndarray
    groups: np.ndarray
    radii: np.ndarray

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.vectors.T, -1, 1))


def _units(vec: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(vec.flatten(), dtype=np.float64).reshape(-1, dims)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _arrow(df: DataFrame, add, schema: str) -> DataFrame:  # noqa: ANN001
    """df with the columns that add gives for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                more = add(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kept}, {schema}")


def dealt(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], first: np.ndarray, span: np.ndarray, name: str, items: str) -> DataFrame:
    """rows (with vec), once for each group of items that a row has to meet, with the group's number and those of its items.

    add gives for unit vectors and their batch which items they meet; item i is in the groups first[i] to first[i] + span[i] - 1.
    """
    members = [np.flatnonzero((first <= g) & (g < first + span)).astype(np.int32) for g in range(int((first + span).max()) if len(first) else 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches if len(first) else ():
            for batch in (whole.slice(lo, DEALT) for lo in range(0, whole.num_rows, DEALT)):
                on = add(V.units(batch.column("vec")), batch)
                for g, own in enumerate(members):
                    some = on[:, own]
                    at = np.flatnonzero(some.any(axis=1))
                    if len(at):
                        some = some[at]
                        ends = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(own[np.nonzero(some)[1]]))
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.full(len(at), g, np.int32)), lists], [*batch.schema.names, name, items])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kept}, {name} int, {items} array<int>")


def ordered(x: np.ndarray) -> np.ndarray:
    """An order of rows in which each is followed by the nearest of those left."""
    order, left = [0], np.ones(len(x), bool)
    left[0] = False
    while left.any():
        near = np.where(left, x @ x[order[-1]], -np.inf)
        order.append(int(near.argmax()))
        left[order[-1]] = False
    return np.array(order)


def choose(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Pivots for n rows: four times the root of n, PIVOTS at most, each the farthest from those before it among a sample of some SAMPLED times as many; only the work depends on them."""
    many = min(PIVOTS, max(1, int(4 * np.sqrt(n))))
    lot = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(max(1, n // (SAMPLED * many)))) == 0
    found = rows.where(lot).select("vec").limit(2 * SAMPLED * many).collect()
    x = np.array([r["vec"] for r in found], np.float64).reshape(-1, dims)
    x = x[(x != 0).any(axis=1)]
    if not len(x):
        return np.eye(1, dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, near = [0], x @ x[0]
    while len(at) < many and near.min() < 1 - 1e-6:
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    return x[at]


def assigned(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """rows with pivot, the number of the nearest one, and its angle."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        at, angle = [], []
        x = _units(batch.column("vec"), dims)
        for lo in range(0, len(x), BLOCK_ROWS):
            a = np.arccos(np.clip(x[lo : lo + BLOCK_ROWS] @ pivots.T, -1, 1))
            at.append(a.argmin(axis=1))
            angle.append(a.min(axis=1))
        return {"pivot": pa.array(np.concatenate(at), pa.int32()), "angle": pa.array(np.concatenate(angle))}

    return _arrow(rows, add, "pivot int, angle double")


def reaching(rows: DataFrame, pivots: Pivots, least: float, half: bool) -> DataFrame:
    """rows (assigned) by group g, with reach: the pivots of the group near which a row can have the similarity with another; with half those from its own on."""
    widest = np.arccos(np.clip(least, -1, 1)) + SLACK

    def add(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        on = pivots.angles(x) <= widest + pivots.radii
        return on & (np.arange(len(pivots.radii)) >= batch.column("pivot").to_numpy()[:, None]) if half else on

    return dealt(rows, add, pivots.groups, np.ones_like(pivots.groups), "g", "reach")


def blocks(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, block: int = BLOCK_ROWS, half: bool = False, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """The two sides dealt into groups of which each pair that can reach the threshold is in one; None without rows.

    The sides' columns are keys, g, lp, rp, id, vec, pivot, those carried, and reach on the left; the names of the groups'
    columns come with them. A row is sent about vectors.SPREAD times at most, unless groups of a task's size are more.
    """
    count, dims = right.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not count:
        return None
    found = choose(right, count, dims)
    found = found[ordered(found)]
    block = max(1, min(max(block, -(-count // V.SPREAD)), max(block, V.COMPONENTS // dims)))
    # zero vectors have no angle; they have similarity 0 with all, which counts where the threshold isn't positive
    some = F.exists("vec", lambda x: x != 0)
    keep = lambda df: df.where(some) if threshold > 0 else df
    r = cut(assigned(keep(right.select("id", "vec", *keys, *carried)), found, dims))
    sizes = {x["pivot"]: (x["n"], x["angle"]) for x in r.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}  # a row a pivot
    radii = np.array([sizes.get(p, (0, -np.inf))[1] for p in range(len(found))]) if threshold > 0 else np.full(len(found), np.inf)
    groups, held = np.zeros(len(found), np.int32), 0
    for p in range(len(found)):  # neighbours share a group up to a block's rows
        n = sizes.get(p, (0, 0))[0]
        new = p > 0 and held + n > block
        groups[p], held = (groups[p - 1] + new if p else 0), (n if new else held + n)
    pivots = Pivots(found, groups, radii)
    source = r if half else cut(assigned(keep(left.select("id", "vec", *keys, *carried)), found, dims))
    l = reaching(source, pivots, threshold, half)
    group = F.element_at(F.array(*map(F.lit, groups.tolist())), F.col("pivot") + 1)
    nl = l.groupBy(*keys, "g").agg(F.ceil(F.count("*") / block).cast("int").alias("nl"))
    nr = r.groupBy(*keys, group.alias("g")).agg(F.ceil(F.count("*") / block).cast("int").alias("nr"))
    counts = cut(nl.join(nr, [*keys, "g"]))
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [*keys, "g", "lp", "rp", "id", "vec", "pivot", *carried]
    dealt_l = l.join(counts, [*keys, "g"]).withColumn("lp", part("nl", 1)).withColumn("rp", all_of("nr")).select(*names, "reach")
    dealt_r = r.withColumn("g", group).join(counts, [*keys, "g"]).withColumn("rp", part("nr", 2)).withColumn("lp", all_of("nl")).select(*names)
    return dealt_l, dealt_r, [*keys, "g", "lp", "rp"]


def similar(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, block: int = BLOCK_ROWS, half: bool = False, carried: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """(a, b, sim) of all pairs of rows that agree in keys and have a cosine of threshold or more.

    left and right have id, vec (of one dimension, finite) and keys. With half, left and right are one table and each
    pair is formed once, a < b. Columns of both that are carried come along as name_a and name_b. With top, pairs of one
    row with itself are left out, and of the others those that can't be among the `top` of a, by similarity and then by b,
    may be; top and half exclude each other. Similarities are vectors.cosines then, so that copies tie in any block.

    Each row belongs to the nearest of some pivots, and a pivot's radius is the largest angle
    of its rows on the right. By the triangle inequality a row can reach the threshold with another only if its angle to
    the other's pivot is at most the threshold's angle and the radius: a row on the left goes to the groups of pivots
    that it can reach, and meets there the rows of these pivots alone. So the work follows the pairs that are near one
    another's pivots; where vectors lie all about and the threshold is wide, it is the product of the two sides. Groups
    hold a block of either side at most, however many rows a key or pivot has, and give their pairs step by step.
    """
    if top is not None and half:
        raise ValueError("the first of each row can't be told from half of the pairs")
    names = keys or ["_all"]
    if not keys:
        left, right = left.withColumn("_all", F.lit(1)), right.withColumn("_all", F.lit(1))
    kinds = [(f"{c}_{s}", right.schema[c].dataType) for s in "ab" for c in carried]
    found = blocks(left, right, names, threshold, block, half, carried)
    schema = ", ".join(["a string", "b string", "sim double", *[f"`{c}` {k.simpleString()}" for c, k in kinds]])
    if found is None:
        return left.sparkSession.createDataFrame([], schema)
    l, r, groups = found
    both = l.withColumn("right", F.lit(False)).unionByName(r.withColumns({"reach": F.lit(None).cast("array<int>"), "right": F.lit(True)}))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        x, y = rows.filter(pc.invert(rows["right"])), rows.filter(rows["right"])
        if not x.num_rows or not y.num_rows:
            return
        m, n = V.units(x["vec"]), V.units(y["vec"])
        x_vec, y_vec = (V.matrix(x["vec"]), V.matrix(y["vec"])) if top else (m, n)
        ids = pc.rank(pa.chunked_array([*x["id"].chunks, *y["id"].chunks]), tiebreaker="dense").to_numpy().astype(np.int64)
        x_id, y_id, x_pivot, y_pivot = ids[: len(m)], ids[len(m) :], x["pivot"].to_numpy(), y["pivot"].to_numpy()
        lists = x["reach"].combine_chunks()
        into, where = lists.flatten().to_numpy(), np.repeat(np.arange(len(m)), lists.value_lengths().to_numpy())
        o, kept = np.argsort(into, kind="stable"), []
        into, where = into[o], where[o]
        order = np.argsort(y_pivot, kind="stable")

        def batch(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            swap = half & (x_id[i] > y_id[j])
            take = lambda c, k: x[c].take(pa.array(k)).combine_chunks()
            other = lambda c, k: y[c].take(pa.array(k)).combine_chunks()
            out = []
            for c in ["id", *carried]:
                p, q = take(c, i), other(c, j)
                out.append((pc.if_else(pa.array(swap), q, p), pc.if_else(pa.array(swap), p, q)) if half else (p, q))
            return pa.RecordBatch.from_arrays([*out[0], pa.array(s), *[c[side] for side in (0, 1) for c in out[1:]]], ["a", "b", "sim", *[c for c, _ in kinds]])

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            step = max(1, (1 << 20) // x_vec.shape[1])
            return np.concatenate([V.cosines(x_vec[i[lo : lo + step]], y_vec[j[lo : lo + step]]) for lo in range(0, len(i), step)])

        def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            i, j, s = (np.concatenate([p[c] for p in parts]) for c in range(3))
            o = np.lexsort((y_id[j], -s, i))
            nth = np.arange(len(o)) - np.searchsorted(i[o], i[o])
            return tuple(c[o[nth < top]] for c in (i, j, s))

        held = 0
        for p in np.unique(y_pivot):
            mine = where[np.searchsorted(into, p) : np.searchsorted(into, p, "right")]
            theirs = order[np.searchsorted(y_pivot[order], p) : np.searchsorted(y_pivot[order], p, "right")]
            for lo in range(0, len(mine), STEP[0]):
                for at in range(0, len(theirs), STEP[1]):
                    a, b = mine[lo : lo + STEP[0]], theirs[at : at + STEP[1]]
                    sims = np.clip(m[a] @ n[b].T, -1, 1)
                    i, j = np.divmod(np.flatnonzero(sims >= (threshold - SLACK if top else threshold)), len(b))
                    s, i, j = sims[i, j], a[i], b[j]
                    if half:
                        on = np.where(x_pivot[i] == y_pivot[j], x_id[i] < y_id[j], x_id[i] != y_id[j])
                    else:
                        on = x_id[i] != y_id[j] if top else np.ones(len(i), bool)
                    if not on.any():
                        continue
                    i, j, s = i[on], j[on], s[on]
                    if top:
                        s = exact(i, j)
                        on = s >= threshold
                        i, j, s = i[on], j[on], s[on]
                    kept.append((i, j, s))
                    held += len(i)
                    if top and held > 4 * top * len(m) + (1 << 20):
                        kept = [best(kept)]
                        held = 0
                    elif not top and held > 1 << 16:
                        yield from (batch(*k) for k in kept)
                        kept, held = [], 0
        if kept:
            yield batch(*(best(kept) if top else (np.concatenate([k[c] for k in kept]) for c in range(3))))

    return both.groupBy(*groups).applyInArrow(pairs, schema)


def compared(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, half: bool = False) -> int:
    """How many pairs similar looks at."""
    names = keys or ["_all"]
    if not keys:
        left, right = left.withColumn("_all", F.lit(1)), right.withColumn("_all", F.lit(1))
    found = blocks(left, right, names, threshold, half=half)
    if found is None:
        return 0
    l, r, _ = found
    n = r.where("lp = 0").groupBy(*names, "pivot").agg(F.count("*").alias("n"))
    rows = l.where("rp = 0").select(*names, "id", F.explode("reach").alias("pivot")).distinct()
    return rows.join(n, [*names, "pivot"]).agg(F.sum("n")).first()[0] or 0
