"""Approximate nearest neighbours: NN-descent builds a graph by joins of neighbours of neighbours, queries walk it greedily."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, in_arrow

#: Neighbours a node keeps, and neighbours that a node's list takes from the nodes that have it as theirs, by kind.
K, BACK = 24, 10
#: Trees that give the first lists, rows of a leaf, neighbours that a leaf gives a row, splits from a tree's root at most, and rows that trees are fitted on (about).
TREES, LEAF, PER_LEAF, DEPTH, FIT_ROWS = 10, 1024, 16, 10, 32768
#: Rounds of NN-descent end once fewer than one in SETTLED entries are new, or after so many.
SETTLED, ROUNDS = 10, 6
#: Nodes that a search holds, opens in a round, and ranks exactly at its end; nodes that queries from outside begin at.
BEAM, STEP, RANKED, ENTRIES = 256, 64, 64, 32
#: Rows that go to all tasks at most; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def valid(embedding: Column) -> Column:
    """Whether a vector has components, all finite, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def encode(x: np.ndarray) -> list[bytes]:
    """Each row as its largest component's size and 16-bit fractions of it."""
    most = np.abs(x).max(axis=1)
    parts = np.rint(x / most[:, None] * 32767).astype(np.int16)
    return [m.tobytes() + p.tobytes() for m, p in zip(most, parts, strict=True)]


def decode(codes: list[bytes]) -> np.ndarray:
    """The rows of codes of one length."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    most = np.ascontiguousarray(raw[:, :8]).view(np.float64)
    return np.ascontiguousarray(raw[:, 8:]).view(np.int16) * (most / 32767)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from inner products; good enough to walk by, not to rank the last results."""
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1), 0))


def best(owner: np.ndarray, other: np.ndarray, away: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k nearest different others, in order of owner and distance; ties go to the smaller number."""
    order = np.lexsort((away, other, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    order = order[np.lexsort((other[order], away[order], owner[order]))]
    own = owner[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[rank < k]


def _ragged(owner: np.ndarray, n: int, *columns: tuple[np.ndarray, pa.DataType]) -> list[pa.Array]:
    """List columns of n rows from values in order of their rows."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind)) for x, kind in columns]


def nodes_of(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """One node a different vector: node, v, its code, its k + 1 smallest vec_ids, and whether a row of it is asked for; written."""
    rows = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    members = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = members.join(rows.where("asked").select("v").distinct().withColumn("asked", F.lit(True)), "v", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [encode(np.array([v]))[0] for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    coded = in_arrow(classes.withColumn("asked", F.coalesce("asked", F.lit(False))), run, "v array<double>, members array<long>, asked boolean, code binary")
    return cut(coded.withColumn("node", F.monotonically_increasing_id()))


@dataclass
class Tree:
    """Splits of a random projection tree, breadth first: a row goes right where its product with the normal is above the bound."""

    normals: np.ndarray
    bounds: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(self.bounds) and at[0] < len(self.bounds):  # all leaves are equally deep
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.normals[at]) > self.bounds[at])
        return at


def fit_tree(sample: np.ndarray, depth: int, random: np.random.Generator) -> Tree:
    """A tree of 2**depth leaves with about as many rows of the sample each; a split's normal is the difference of two of its rows."""
    normals, bounds = np.zeros((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
    at = {0: np.arange(len(sample))}
    for split in range(2**depth - 1):
        rows = at.pop(split)
        normals[split], high = _halve(sample[rows], random)
        bounds[split] = np.median(sample[rows] @ normals[split]) if len(rows) else 0.0
        at[2 * split + 1], at[2 * split + 2] = rows[~high], rows[high]
    return Tree(normals, bounds)


def _halve(x: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The difference of two of the rows, and which rows are beyond the median along it."""
    if len(x) < 2:
        return np.ones(x.shape[1]), np.zeros(len(x), bool)
    a, b = random.choice(len(x), 2, replace=False)
    along = x @ (x[a] - x[b])
    return x[a] - x[b], along > np.median(along)


def first_lists(nodes: DataFrame, k: int) -> DataFrame:
    """node, nbrs, dists, fresh: for each node the nearest of the leaves that TREES trees put it in; written.

    The trees are fitted on about FIT_ROWS rows, all rows go through them. A leaf with more than LEAF rows is split
    further in its task.
    """
    sizes = {r["dims"]: r["n"] for r in nodes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row a vector length
    total, trees = sum(sizes.values()), {}
    held: dict[int, list[bytes]] = {}
    for r in nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(total, 1))) < FIT_ROWS).select("code").collect():
        held.setdefault(len(r["code"]), []).append(bytes(r["code"]))
    for dims, n in sizes.items():
        sample = decode(held[8 + 2 * dims]) if 8 + 2 * dims in held else np.zeros((0, dims))
        depth = max(0, min(DEPTH, int(np.ceil(np.log2(n / LEAF))), int(np.log2(max(len(sample), 1) / 16))))
        trees[dims] = [fit_tree(sample, depth, np.random.default_rng([t, dims])) for t in range(TREES)]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_pylist()
            lengths = np.array([len(c) for c in codes])
            out = np.zeros((batch.num_rows, TREES), np.int32)
            for length in np.unique(lengths).tolist():
                on = np.flatnonzero(lengths == length)
                x = decode([codes[i] for i in on])
                for t, tree in enumerate(trees[x.shape[1]]):
                    out[on, t] = tree.leaves(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TREES), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), lists], ["node", "code", "leaves"])

    def within(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), decode(table.column("code").to_pylist())
        random = np.random.default_rng([table.column("tree")[0].as_py(), table.column("leaf")[0].as_py()])
        todo, found = [np.arange(len(ids))], []
        while todo:
            rows = todo.pop()
            if len(rows) > LEAF:
                high = _halve(x[rows], random)[1]
                if high.any() and not high.all():
                    todo += [rows[high], rows[~high]]
                    continue
            for at in range(0, len(rows), LEAF):  # one block of distances at a time
                some = rows[at : at + LEAF]
                away = distances(x[some], x[rows])
                away[np.arange(len(some)), np.arange(at, at + len(some))] = np.inf
                many = min(PER_LEAF if len(rows) > PER_LEAF + 1 else len(rows) - 1, k)
                near = np.argpartition(away, max(many - 1, 0), axis=1)[:, :many]
                found.append((some, rows[near], np.take_along_axis(away, near, 1)))
        lists = [(ids[n], ids[o.reshape(-1)], d.reshape(-1), o.shape[1]) for n, o, d in found]
        ends = np.concatenate([[0], *(np.full(len(n), w) for n, _, _, w in lists)]).cumsum().astype(np.int32)
        nbrs, dists = (np.concatenate([x[i] for x in lists]) for i in (1, 2))
        return pa.table({"node": np.concatenate([x[0] for x in lists]), "nbrs": pa.ListArray.from_arrays(pa.array(ends), pa.array(nbrs, pa.int64())), "dists": pa.ListArray.from_arrays(pa.array(ends), pa.array(dists, pa.float64()))})

    placed = in_arrow(nodes.select("node", "code"), leaves, "node long, code binary, leaves array<int>").select("node", "code", F.length("code").alias("long"), F.posexplode("leaves").alias("tree", "leaf"))
    lists = placed.groupBy("long", "tree", "leaf").applyInArrow(within, "node long, nbrs array<long>, dists array<double>")
    lists = lists.groupBy("node").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"), F.flatten(F.collect_list("dists")).alias("dists"))  # TREES lists at most

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs = batch.column("nbrs")
            owner = np.repeat(np.arange(batch.num_rows), nbrs.value_lengths().to_numpy())
            other, away = nbrs.flatten().to_numpy(), batch.column("dists").flatten().to_numpy()
            on = best(owner, other, away, k)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *_ragged(owner[on], batch.num_rows, (other[on], pa.int64()), (away[on], pa.float64()), (np.ones(len(on), bool), pa.bool_()))], ["node", "nbrs", "dists", "fresh"])

    return cut(in_arrow(lists, merge, _GRAPH))


_GRAPH = "node long, nbrs array<long>, dists array<double>, fresh array<boolean>"


def _pairs(lists: DataFrame) -> DataFrame:
    """node, nbr, dist of the members of each list that are nearer to each other than the farthest neighbour either has; one of the two is new to the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column("members").to_pylist():
                ids, x = np.array([m["member"] for m in members]), decode([m["code"] for m in members])
                fresh, worst = (np.array([m[c] for m in members]) for c in ("fresh", "worst"))
                away = distances(x, x)
                a, b = np.nonzero((fresh[:, None] | fresh) & (away < worst[:, None]) & (ids[:, None] != ids))
                found.append((ids[a], ids[b], away[a, b]))
            node, nbr, dist = (np.concatenate([f[i] for f in found]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(dist, pa.float64())], ["node", "nbr", "dist"])

    return in_arrow(lists, run, "node long, nbr long, dist double")


def descend(nodes: DataFrame, graph: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: all members of a node's list, its neighbours and some that have it as theirs, become candidates of each other; written.

    A list takes all of a node's own neighbours, and by a hash BACK new and BACK old ones of those that have it as
    theirs, so that lists are short at nodes that many have as theirs. Only pairs of which one is new since the round
    before are compared. A node then keeps the k nearest of its neighbours and candidates.
    """
    edges = graph.select("node", F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.fresh").alias("fresh"))
    lot = F.row_number().over(Window.partitionBy("at", "fresh").orderBy(F.xxhash64("member", F.lit(turn)), "member"))
    back = edges.select(F.col("nbr").alias("at"), F.col("node").alias("member"), "fresh").withColumn("lot", lot).where(F.col("lot") <= BACK).drop("lot")
    both = edges.select(F.col("node").alias("at"), F.col("nbr").alias("member"), "fresh").unionByName(back).groupBy("at", "member").agg(F.max("fresh").alias("fresh"))
    worst = F.when(F.size("dists") >= k, F.array_max("dists")).otherwise(float("inf"))
    members = nodes.select("node", "code").join(graph.select("node", worst.alias("worst")), "node").withColumnRenamed("node", "member")
    lists = both.join(members, "member").groupBy("at").agg(F.collect_list(F.struct("member", "fresh", "code", "worst")).alias("members"))
    found = _pairs(lists.where(F.exists("members", lambda m: m["fresh"])).select("members"))
    near = found.groupBy("node", "nbr").agg(F.min("dist").alias("dist"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("dist", "nbr"))).where(F.col("rank") <= k)
    near = near.groupBy("node").agg(F.collect_list("nbr").alias("more"), F.collect_list("dist").alias("more_dists"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            parts = []
            for ids, dists, fresh in (("nbrs", "dists", False), ("more", "more_dists", True)):
                sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy()
                parts.append((np.repeat(rows, sizes), batch.column(ids).flatten().to_numpy(), batch.column(dists).flatten().to_numpy(), np.full(sizes.sum(), fresh)))
            owner, other, away, fresh = (np.concatenate([p[i] for p in parts]) for i in range(4))
            # what a node has already is not new, though a candidate's distance may differ in its last bits
            order = np.lexsort((fresh, other, owner))
            once = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (other[order][1:] != other[order][:-1])] if len(order) else np.zeros(0, bool)
            owner, other, away, fresh = (x[order[once]] for x in (owner, other, away, fresh))
            on = best(owner, other, away, k)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *_ragged(owner[on], batch.num_rows, (other[on], pa.int64()), (away[on], pa.float64()), (fresh[on], pa.bool_()))], ["node", "nbrs", "dists", "fresh"])

    return cut(in_arrow(graph.select("node", "nbrs", "dists").join(near, "node", "left"), merge, _GRAPH))


def links_of(graph: DataFrame, k: int) -> DataFrame:
    """node, nbrs: a node's neighbours and the k nearest of those that have it as theirs; written."""
    edges = graph.select("node", F.explode(F.arrays_zip("nbrs", "dists")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist"))
    back = edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "dist")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("dist", "nbr"))).where(F.col("rank") <= k)
    back = back.groupBy("node").agg(F.collect_list("nbr").alias("back"))
    return cut(graph.join(back, "node", "left").select("node", F.array_distinct(F.concat("nbrs", F.coalesce("back", F.array().cast("array<long>")))).alias("nbrs")))


@dataclass
class Graph:
    """nodes: node, v, code, members, asked; links: node, nbrs."""

    nodes: DataFrame
    links: DataFrame
    k: int


def build(vectors: DataFrame, asked: Column | None = None, k: int = 10, neighbours: int = K) -> Graph:
    """The graph of all valid vectors for searches of k; equal vectors are one node.

    vectors has vec_id long and embedding, an array of numbers. Rows without an id, and vectors that are null, empty,
    zero or hold null or non-finite components, take no part; vectors are neighbours only of vectors of their length.
    """
    nodes = nodes_of(vectors, F.lit(False) if asked is None else asked, k)
    graph = first_lists(nodes, neighbours)
    for turn in range(ROUNDS):
        after = descend(nodes, graph, neighbours, turn)
        discard(graph)
        graph = after
        new, of = graph.select(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if (new or 0) * SETTLED < (of or 1):
            break
    links = links_of(graph, neighbours)
    discard(graph)
    return Graph(nodes, links, k)


_STATE = "q long, code binary, ids array<long>, dists array<double>, done array<boolean>, seen array<long>, frontier array<long>"


def _opened(states: DataFrame) -> DataFrame:
    """states with the fetched nodes merged in: the BEAM nearest stay, the nearest STEP that weren't opened are next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                fetched = r["fetched"] or []
                new = np.array([f["node"] for f in fetched], np.int64)
                away = distances(decode([r["code"]]), decode([f["code"] for f in fetched]))[0] if fetched else np.zeros(0)
                ids, dists = np.concatenate([np.array(r["ids"], np.int64), new]), np.concatenate([np.array(r["dists"], np.float64), away])
                done = np.concatenate([np.array(r["done"], bool), np.zeros(len(new), bool)])
                on = np.lexsort((ids, dists))[:BEAM]
                ids, dists, done = ids[on], dists[on], done[on]
                todo = np.flatnonzero(~done)[:STEP]
                done[todo] = True
                rows.append((r["q"], r["code"], ids, dists, done, np.concatenate([np.array(r["seen"], np.int64), new]), ids[todo]))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [f.split()[0] for f in _STATE.split(", ")])

    return in_arrow(states, run, _STATE)


def walk(graph: Graph, starts: DataFrame) -> DataFrame:
    """q, ids: for each q the nodes that a greedy search from its start nodes holds in the end, nearest first; written.

    starts has q long, code and start, an array of nodes. Each round all searches open the nearest STEP of their BEAM
    nodes that they haven't opened; nodes linked to these that were not seen before are fetched and take their places.
    A search ends when all nodes it holds are open.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    ahead = cut(starts.select("q", "code", none("long").alias("ids"), none("double").alias("dists"), none("boolean").alias("done"), none("long").alias("seen"), F.col("start").alias("todo")))
    ended = None
    while True:
        wanted = ahead.select("q", F.explode("todo").alias("node"))
        small = F.broadcast(wanted) if (ahead.agg(F.sum(F.size("todo"))).first()[0] or 0) <= BROADCAST_ROWS else wanted
        fetched = graph.nodes.select("node", "code").join(small, "node").groupBy("q").agg(F.collect_list(F.struct("node", "code")).alias("fetched"))
        states = cut(_opened(ahead.drop("todo").join(fetched, "q", "left")))
        discard(ahead)
        over = states.where("size(frontier) = 0").select("q", "ids")
        ended = cut(over, onto=ended)
        live = states.where("size(frontier) > 0")
        steps = live.agg(F.sum(F.size("frontier"))).first()[0]
        if not steps:
            discard(states)
            return ended
        frontier = live.select("q", F.explode("frontier").alias("node"))
        frontier = F.broadcast(frontier) if steps <= BROADCAST_ROWS else frontier
        linked = graph.links.join(frontier, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("linked"))  # STEP lists at most
        ahead = cut(live.join(linked, "q", "left").select("q", "code", "ids", "dists", "done", "seen", F.array_except(F.coalesce("linked", none("long")), "seen").alias("todo")))
        discard(states)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, of arrays of doubles, summed in their order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def ranked(graph: Graph, held: DataFrame, queries: DataFrame) -> DataFrame:
    """q and found: the k + 1 nearest rows by exact distance, as an array of score and vec_id, ties to the smaller id.

    held has q and ids as walk gives them, of which the RANKED nearest are taken; queries has q and its vector v.
    """
    near = held.select("q", F.explode(F.slice("ids", 1, RANKED)).alias("node")).join(graph.nodes.select("node", "members", F.col("v").alias("other")), "node")
    rows = near.join(queries.select("q", "v"), "q").select("q", F.explode("members").alias("vec_id"), distance(F.col("v"), F.col("other")).alias("score"))
    return rows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, graph.k + 1).alias("found"))


def _listed(rows: DataFrame, found: Column, k: int) -> DataFrame:
    return rows.select("query_id", F.posexplode(F.slice(found, 1, k)).alias("place", "f")).select("query_id", (F.col("place") + 1).alias("rank"), "f.vec_id", "f.score")


def nearest_rows(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest other rows found for each query row, by Euclidean distance, nearest first, ties to the smaller id.

    Each query starts at its own node of the graph, see build for the rows that take part. Scores and order are of the
    original vectors in double precision. Rows that share an id are rows of their own; repeated rows find each other at
    distance 0. Queries with fewer than k others get all; an empty table gives an empty result.

    Returns query_id long, rank int from 1, vec_id long, score double.
    """
    graph = build(vectors, is_query, k)
    asked = graph.nodes.where("asked").select(F.col("node").alias("q"), "code", "v")
    held = walk(graph, asked.select("q", "code", F.array("q").alias("start")))
    found = ranked(graph, held, asked).join(asked.select("q", "v"), "q").select("v", "found")
    queries = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")) & is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    out = queries.join(found, "v")
    own = F.array_position(F.transform("found", lambda f: (f["vec_id"] == F.col("query_id")) & (f["score"] == 0)), F.lit(True))
    out = cut(_listed(out.withColumn("own", own), F.filter("found", lambda f, i: i + 1 != F.col("own")), k))
    discard(held, graph.nodes, graph.links)
    return out


def nearest(graph: Graph, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows of the graph found for queries from outside, which start at ENTRIES nodes of each vector length.

    queries has query_id and embedding; those without a valid vector get nothing, ids may repeat. k is at most the graph's.
    """
    if k > graph.k:
        raise ValueError(f"the graph is built for searches of {graph.k}")
    lot = F.row_number().over(Window.partitionBy(F.length("code")).orderBy(F.xxhash64("node")))
    entries = graph.nodes.select("node", F.length("code").alias("long"), lot.alias("lot")).where(F.col("lot") <= ENTRIES).groupBy("long").agg(F.collect_list("node").alias("start"))
    rows = queries.where(valid(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [encode(np.array([v]))[0] for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    rows = cut(in_arrow(rows, run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, v array<double>, code binary").withColumn("q", F.monotonically_increasing_id()))
    held = walk(graph, rows.join(F.broadcast(entries), F.length("code") == F.col("long")).select("q", "code", "start"))
    found = ranked(graph, held, rows).join(rows.select("q", "query_id"), "q")
    out = cut(_listed(found, F.col("found"), k))
    discard(held, rows)
    return out
