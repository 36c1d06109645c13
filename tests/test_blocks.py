"""Products of blocks: how often rows are sent, what a batch grows to, and ranks among copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.functions import vectors as V
from lorehouse.operators import similarity
from lorehouse.operators.vector_index import VectorIndex


def frame(spark, x):
    return spark.createDataFrame([(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")


def plain(x, ids, k):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(np.clip(x @ x.T, -1, 1), 9)
    return {(ids[i], ids[j], n + 1) for i in range(len(x)) for n, j in enumerate(np.lexsort((ids, -s[i]))[:k])}


@pytest.mark.parametrize("step", [(512, 1024), (7, 30)])
def test_ranks_among_copies(spark, step, monkeypatch):
    """Half of the rows are one vector: of what ties the smaller ids are given, whatever the steps."""
    monkeypatch.setattr(V, "STEP", step)
    x = np.random.default_rng(5).normal(size=(300, 8))
    x[::2] = x[0]
    ids = np.random.default_rng(6).permutation([f"v{i:05d}" for i in range(300)])
    best = V.Best(V.units(_lists(x)), V.units(_lists(x)), _array(ids), 5)
    best.meet(np.arange(300), best.by_id)
    i, j, _ = best.found()
    assert {(ids[a], ids[b], n % 5 + 1) for n, (a, b) in enumerate(zip(i, j, strict=True))} == plain(x, ids, 5)


def _array(ids):
    import pyarrow as pa

    return pa.array(ids.tolist())


def _lists(x):
    import pyarrow as pa

    return pa.array(x.tolist(), pa.list_(pa.float64()))


def test_vectors_of_two_lengths_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError, match="one dimension"):
        V.matrix(pa.array([[1.0, 2.0], [1.0]]))
    with pytest.raises(ValueError, match="one dimension"):
        V.matrix(pa.array([[1.0], None]))


def test_blocks_do_not_grow_with_the_rows(spark):
    size = spark.createDataFrame([(n,) for n in (0, 100, 40_000, 100_000, 1_000_000, 10_000_000)], "n long").select(V.blocks(F.col("n"), F.lit(64)).alias("b"))
    assert [r["b"] for r in size.collect()] == [1, 1, 16, 16, 16, 153]


def test_a_query_goes_to_few_bands_with_its_lists(spark, tmp_path):
    """On vectors that lie all about a query looks at nearly all lists: its vector is sent once a band, not once a list."""
    x = np.random.default_rng(7).normal(size=(4000, 16))
    df = frame(spark, x)
    index = VectorIndex.build(df, f"file://{tmp_path}/index")
    bands = index._bands()
    asked = df.select(F.col("id").alias("query_id"), "vec", F.lit(-1.0).alias("least"))
    sent = index._probed(asked, 63, bands)
    assert len(index.centres()[0]) == 63
    assert sent.agg(F.sum(F.size("lists"))).first()[0] == 63 * 4000
    assert sent.count() <= 3 * 4000
    got = index.exact(df.where("id < 'v00100'").select(F.col("id").alias("query_id"), "vec"), 5)
    want = V.nearest(df.where("id < 'v00100'").select(F.col("id").alias("query_id"), "vec"), df, 5)
    rows = lambda out: sorted(tuple(r) for r in out.select("query_id", "place", "id", "sim").collect())
    assert rows(got) == rows(want)


def test_a_crowded_list_has_several_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    monkeypatch.setattr(V, "SPREAD", 8)
    x = np.ones((900, 4)) + np.random.default_rng(8).normal(size=(900, 4)) * 1e-3
    df = frame(spark, x)
    index = VectorIndex.build(df, f"file://{tmp_path}/index", lists=2)
    first, span, rows = index._bands()
    assert rows.sum() == 900 and span.sum() >= 7 and len({b for f, s in zip(first, span, strict=True) for b in range(f, f + s)}) == span.sum()
    q = df.where("id < 'v00060'").select(F.col("id").alias("query_id"), "vec")
    assert sorted(map(tuple, index.exact(q, 3).select("query_id", "place", "id").collect())) == sorted(map(tuple, V.nearest(q, df, 3).select("query_id", "place", "id").collect()))


def test_a_row_is_sent_once_a_group_with_its_pivots(spark):
    """Each two vectors can reach a threshold of 0: a row is sent once a group, and the groups' pivots add up to all."""
    x = np.random.default_rng(9).normal(size=(1500, 8))
    df = frame(spark, x).withColumn("k", F.lit(1))
    left, right, _ = similarity.blocks(df, df, ["k"], 0.0, 20)
    groups = right.select("g").distinct().count()
    assert groups <= 2 * V.SPREAD
    once = left.where("rp = 0").groupBy("id").agg(F.count("*").alias("n"), F.sum(F.size("reach")).alias("pivots"), F.count_distinct("g").alias("g"))
    pivots = right.select("pivot").distinct().count()
    assert once.where(f"n <> {groups} or g <> n or pivots < {pivots}").isEmpty()


def test_top_and_carried_columns(spark):
    x = np.random.default_rng(10).normal(size=(200, 4))
    x[:40] = x[0]
    df = frame(spark, x).withColumn("w", F.length("id") + F.substring("id", 2, 5).cast("int"))
    every = similarity.similar(df, df, [], 0.3, 60, carried=["w"]).where("a <> b").collect()
    want = {}
    for r in sorted(every, key=lambda r: (r["a"], -r["sim"], r["b"])):
        want.setdefault(r["a"], []).append((r["b"], r["w_a"], r["w_b"]))
    got = {}
    for r in sorted(similarity.similar(df, df, [], 0.3, 60, carried=["w"], top=3).collect(), key=lambda r: (r["a"], -r["sim"], r["b"])):
        got.setdefault(r["a"], []).append((r["b"], r["w_a"], r["w_b"]))
    assert {a: v[:3] for a, v in got.items()} == {a: v[:3] for a, v in want.items()}
    assert all(r["w_a"] == 6 + int(r["a"][1:]) and r["w_b"] == 6 + int(r["b"][1:]) for r in every)
    half = similarity.similar(df, df, [], 0.3, 60, half=True, carried=["w"]).collect()
    assert len(half) * 2 == len(every) and all(r["w_a"] == 6 + int(r["a"][1:]) and r["w_b"] == 6 + int(r["b"][1:]) for r in half)
