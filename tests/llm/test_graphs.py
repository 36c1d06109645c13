"""Prefix tries, vector codes and neighbour graphs against plain Python, and their awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorehouse.llm import codes, common, nndescent, queries, sharding, topk, trie
from lorehouse.sources import scratch

SF = "/root/testdata/sf0.001"

# Arrow batches


def test_batches_are_small_in_a_plain_session(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    own = spark.newSession()
    assert max(r["n"] for r in common.in_arrow(own.range(0, 5000, 1, 1), run, "n long").collect()) == 1000
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
    assert max(r["n"] for r in common.in_arrow(own.range(0, 5000, 1, 1), run, "n long").collect()) == 2500


# Prefix trie


def plain_trie(rows):
    """(conv_id, depth) to the other columns, by holding every prefix."""
    own = defaultdict(list)
    for cid, turn, role, text in rows:
        if cid is not None:
            own[cid].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    own = {c: [(t[3], t[5]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    saved, leaves, out = {}, {}, {}
    for n in sorted(members, key=len, reverse=True):
        m = members[n]
        saved[n] = (len(m) - 1) * (len(n[-1][1]) if n else 0) + sum(saved[x] for x in children[n])
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        above = min(members[n[:-1]]) if n else None
        out[min(m), len(n)] = (above, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(turns):
    rows = trie.prefix_trie(*trie.crossed(trie.numbered(turns))).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(330), 70):
        n = rng.choice((1, 1, 2, 3, 6, 9, 17, 33))
        rows += [(c, t if t else None, rng.choice(("user", "", None)), rng.choice(("a", "", None, "ß😀", "b"))) for t in range(n)]
    rows += rng.sample(rows, 5) + [(c, t, "user", "same") for c in (400, 401, 402, 455, 499) for t in range(8)]
    rng.shuffle(rows)
    assert found_trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_trie_of_awkward_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found_trie(empty) == {}
    # turnless ones: their own turns are all replaced and the first conversation is absent
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(gone, 0, "user", "x"), (None, 0, "user", "no id"), (-7, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"name": F.lit("clash"), "depth": F.lit(0)})
    assert (gone, 0) not in found_trie(df) and found_trie(df)[-7, 0][1] == 2
    one = [(5, 0, "user", "x" * 300_000)]
    assert found_trie(spark.createDataFrame(one, SCHEMA))[5, 0][4] == 0


def test_trie_of_one_long_conversation(spark):
    """Blocks of sums and ranges of positions: one conversation has nearly all turns."""
    rows = [(500, t, "user", f"{t % 7}") for t in range(2500)] + [(501, t, "user", f"{t % 7}") for t in range(40)]
    assert found_trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_trie_pieces_of_long_lists(spark):
    rows = [(1, c) for c in [*range(-5000, 9000, 3), 10**12]] + [(2, 4)]
    got = {r["name"]: r["ends_sha256"] for r in trie.ends(spark.createDataFrame(rows, "name long, conv_id long")).collect()}
    assert got == {n: hashlib.sha256(",".join(str(c) for m, c in rows if m == n).encode()).hexdigest() for n in (1, 2)}


# Codes


def plain_codes(ids, vectors):
    """Lloyd's rounds without bounds, in whole numbers of Python."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, vectors[i]))
    rows = [vectors[i] for i in order]
    parts = codes.cuts(len(rows[0])) if rows else []
    books = [[list(r[p]) for r in rows[:256]] for p in parts]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(4):
        for p, book in zip(parts, books, strict=True):
            sums = defaultdict(list)
            for r in rows:
                sums[nearest(r[p], book)[1]].append(r[p])
            for i, xs in sums.items():
                book[i] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    found = {}
    for i, r in zip(order, rows, strict=True):
        near = [nearest(r[p], book) for p, book in zip(parts, books, strict=True)]
        found[ids[i], tuple(r)] = ("".join(f"{n:02x}" for _, n in near), sum(d for d, _ in near))
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_against_plain_python(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-40, 40, (30, 12))
    vectors = [tuple(int(x) for x in centres[rng.integers(30)] + rng.integers(-3, 4, 12)) for _ in range(400)]
    vectors += vectors[:20] + [vectors[0]] * 30  # copies, so that entries are equal and stay unused
    ids = [int(x) for x in rng.permutation(len(vectors) - 5)] + [None] * 3 + [7, 7]
    want, sha = plain_codes(ids, vectors)
    rows = [(i, list(v), "x") for i, v in zip(ids, vectors, strict=True)]
    coded, books = codes.compress(spark.createDataFrame(rows, "vec_id long, v array<long>, part string"))
    assert codes.digest(books) == sha
    got = coded.collect()
    assert len(got) == len(rows) and {r["part"] for r in got} == {"x"}
    by_id = defaultdict(list)
    for (i, _), x in want.items():
        by_id[i].append(x)
    assert all((r["code"], r["error"]) in by_id[r["vec_id"]] for r in got)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(5)
    x = (rng.integers(-500, 500, (40, 8))[rng.integers(40, size=3000)] + rng.integers(-9, 10, (3000, 8))).astype(np.int64)
    entries = x[:64].copy()
    state, scanned, moved = (None, None, None), [], None
    for _ in range(6):
        code, upper, lower, n = codes.assign(x, entries, *state, moved) if moved is not None else codes.assign(x, entries)
        assert (code == codes.squared(x, entries).argmin(axis=1)).all()
        scanned.append(n)
        new = np.array([x[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else entries[e] for e in range(64)])
        moved = np.sqrt(((new - entries) ** 2).sum(axis=1)) * (1 + codes.SLACK)
        entries, state = new, (code, upper, lower)
    assert scanned[0] == 3000 and scanned[-1] < 1500


def test_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(3, [0.5] * 4, 1), (1, [0.25] * 4, None), (2, [0.5, None, 0.5, 0.5], 1), (4, None, 1), (5, [float("nan")] * 4, 1), (6, [float("inf")] * 4, 2), (3, [0.5] * 4, None), (7, [0.1] * 6, 2), (8, [], 2)]
    v = spark.createDataFrame(rows, schema).select("vec_id", "label", topk.quantise(F.col("embedding")).alias("v"))
    coded, books = codes.compress(v)
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.with_label_errors(coded).collect())
    assert [r[0] for r in got] == [1, 3, 3, 7, 8] and {d: len(b[0]) for d, b in books.items()} == {4: 3, 6: 1, 0: 1}
    assert {r[1:] for r in got if r[0] == 3} == {("01010101", 0, 0)} and all(r[2:] == (0, 0) for r in got)
    coded, books = codes.compress(v.limit(0))
    assert books == {} and codes.with_label_errors(coded).collect() == []
    assert codes.digest({}) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="too large"):
        codes.squared(np.array([[2**40]]), np.array([[-(2**40)]]))
    assert codes.squared(np.array([[2**29]]), np.array([[-(2**29)]])) == 2**60


def test_label_errors_by_shuffling(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{i:02x}", i, i % 3 or None) for i in range(50)], "vec_id long, code string, error long, label int")
    want = sorted(map(tuple, codes.with_label_errors(df).collect()))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, codes.with_label_errors(df).collect())) == want
    assert {r[4] for r in want if r[3] is None} == {sum(range(0, 50, 3))}


# Neighbours


def plain_nearest(rows, ids, k=10):
    """Of rows (id, vector) those of the query ids: (query_id, rank, vec_id, score), brute force."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q in ids:
            near = sorted((math.dist(v, w), x) for j, (x, w) in enumerate(rows) if j != i and len(w) == len(v))[:k]
            out += [(q, n, x, s) for n, (s, x) in enumerate(near, 1)]
    return out


def test_neighbours_reach_their_recall(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_nearest(rows, {q for q, _ in rows if q % 100 == 0})
    got = queries.op13_neighbours(spark, SF).collect()
    assert len(got) == len(want)
    scores = {(q, x): s for q, _, x, s in want}
    hits = [r for r in got if (r["query_id"], r["vec_id"]) in scores]
    assert len(hits) >= 0.9 * len(want)
    assert all(r["score"] == pytest.approx(scores[r["query_id"], r["vec_id"]], rel=1e-14) for r in hits)


def test_neighbours_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(0, 3, 3)]) for i in rng.permutation(200)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(i, v) for i, v in rows if i % 50 == 0] + [(300 + i, [1.0, 1.0, 1.0, float(i)]) for i in range(4)]
    odd = [(None, [1.0] * 3), (400, None), (400, [0.0] * 3), (400, [1.0, None, 1.0]), (400, [float("nan")] * 3), (400, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = sorted(map(tuple, nndescent.nearest_rows(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == sorted(plain_nearest(rows, {0, 100, 200, 300}))
    assert nndescent.nearest_rows(df.limit(0), F.lit(True)).collect() == []


def test_neighbours_of_outside_queries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    graph = nndescent.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = [("a", rng.normal(size=8).tolist()), ("a", rng.normal(size=8).tolist()), ("b", rows[5][1]), ("c", None), ("d", [1.0])]
    got = nndescent.nearest(graph, spark.createDataFrame(asked, "query_id string, embedding array<double>"), 5).collect()
    x, hits = np.array([v for _, v in rows]), 0
    for q, v in asked[:3]:
        near = set(np.argsort(((x - v) ** 2).sum(axis=1))[:5].tolist())
        hits += len(near & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 15 and hits >= 14 and {r["query_id"] for r in got} == {"a", "b"}
    with pytest.raises(ValueError, match="built for"):
        nndescent.nearest(graph, None, 11)


def test_codes_of_a_row_come_back():
    x = np.random.default_rng(8).normal(size=(50, 64)) * 10.0 ** np.arange(-20, 30)[:, None]
    back = nndescent.decode(nndescent.encode(x))
    assert (np.abs(back - x).max(axis=1) <= np.abs(x).max(axis=1) / 32767).all()


# Written tables


def test_results_leave_one_table(spark):
    """The shared folder gains what the result reads, and nothing else."""
    def tables():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.shared_dir(spark)}/lorehouse")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()

    for name in ("pipeline", "op7_mix", "op12_codes"):
        before = tables()
        assert __spark_entry__.queries()[name](spark, SF).count()
        assert len(tables() - before) == 1, name


def test_ball_trees_come_back_whole():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-50, 50, (3000, 6))
    tree = topk.BallTree(np.arange(3000), np.arange(3000) * 2, vectors)
    back = topk.BallTree.from_bytes(tree.to_bytes())
    for query in vectors[:20]:
        bounds = query @ tree.centres.T + np.sqrt((query**2).sum()) * tree.radii + 1e-6
        want, got = (t.search(query, -1, bounds, [], 10, True) for t in (tree, back))
        assert sorted(want) == sorted(got) and sorted(s for s, _, _ in got) == sorted((vectors @ query).tolist())[-10:]


def test_shards_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 90)) for i in range(200)], "doc_id long, text string").repartition(5)
    sharding.write_shards(df, ["doc_id"], F.octet_length("text") + 1, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted(map(tuple, df.collect())) and {r["shard"] for r in back} == {0, 1, 2, 3}
    total = sum(r["size"] for r in back)
    for s in range(4):
        mine = sorted((r["slot"], r["doc_id"]) for r in back if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
        assert abs(sum(r["size"] for r in back if r["shard"] == s) - total / 4) < 100
