"""The similarity join against brute force, and how its work grows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.functions import vectors
from lorehouse.operators import similarity
from lorehouse.operators.vector_index import VectorIndex
from lorehouse.plans import retrieval


def clustered(n, seed=0, dims=16):
    """Vectors near one of n / 50 centres, some of them copies and some zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 50, dims))[rng.integers(n // 50, size=n)] + rng.normal(size=(n, dims)) * 0.08
    x[:3] = x[5]
    x[7] = 0
    return x


def frame(spark, x, kind=lambda i: "k"):
    return spark.createDataFrame([(f"v{i:05d}", v.tolist(), kind(i)) for i, v in enumerate(x)], "id string, vec array<double>, kind string")


def brute(x, y, least):
    norm = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return norm(x) @ norm(y).T >= least


@pytest.mark.parametrize("least", [0.9, 0.2, -0.1])
def test_all_pairs_and_no_others(spark, least, monkeypatch):
    monkeypatch.setattr(similarity, "PIVOTS", 12)
    x = np.concatenate([clustered(400), np.random.default_rng(1).normal(size=(100, 16))])
    df = frame(spark, x, lambda i: "hot" if i % 4 else f"k{i % 3}")
    kinds = np.array([r["kind"] for r in df.orderBy("id").collect()])
    near = brute(x, x, least)
    for keys, same in (([], True), (["kind"], kinds[:, None] == kinds)):
        got = [(r["a"], r["b"]) for r in similarity.similar(df, df, keys, least, 60, half=True).collect()]
        i, j = np.nonzero(np.triu(near & same, 1))
        assert sorted(got) == sorted((f"v{a:05d}", f"v{b:05d}") for a, b in zip(i, j, strict=True))
    left, right = df.where("id < 'v00150'"), df.where("id >= 'v00100'")
    got = [(r["a"], r["b"]) for r in similarity.similar(left, right, ["kind"], least, 60).collect()]
    i, j = np.nonzero((near & (kinds[:, None] == kinds))[:150, 100:])
    assert sorted(got) == sorted((f"v{a:05d}", f"v{b + 100:05d}") for a, b in zip(i, j, strict=True))


def test_work_follows_near_pairs(spark):
    """Ten times the rows in as dense clusters: far under a hundred times the pairs, none lost."""
    work = []
    for n in (1000, 10000):
        x = clustered(n, 2)
        df = frame(spark, x)
        work.append(similarity.compared(df, df, [], 0.9, half=True))
        assert similarity.similar(df, df, [], 0.9, half=True).count() == np.triu(brute(x, x, 0.9), 1).sum()
    assert work[0] < 0.2 * 1000 * 999 / 2
    assert work[1] < 40 * work[0]


def test_tables_without_pairs(spark):
    df = frame(spark, clustered(60))
    none = df.limit(0)
    assert similarity.similar(none, none, [], 0.5, half=True).collect() == []
    assert similarity.similar(df, none, ["kind"], 0.5).collect() == []
    assert similarity.similar(none, df, ["kind"], 0.5).collect() == []
    zero = df.withColumn("vec", F.transform("vec", lambda x: x * 0))
    assert similarity.similar(zero, zero, [], 0.5, half=True).collect() == []
    assert similarity.similar(zero, zero, [], 0.0, half=True).count() == 60 * 59 // 2
    assert similarity.compared(none, none, [], 0.5) == 0


# The vector index


def test_index_search_reaches_its_recall(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r["query_id"], r["id"]) for r in retrieval.vector_index_exact(spark, sf).collect()}
    got = {(r["query_id"], r["id"]) for r in retrieval.vector_index_search(spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_index_of_clusters_looks_at_few_lists(spark, tmp_path):
    x = clustered(3000, 3)
    df = frame(spark, x)
    index = VectorIndex.build(df, f"file://{tmp_path}/index")
    queries = df.where("id < 'v00200'").select(F.col("id").alias("query_id"), "vec")
    want = vectors.nearest(queries, df.where(F.exists("vec", lambda v: v != 0)), 10).where("query_id <> 'v00007'")
    rows = lambda out: sorted((r["query_id"], r["place"], r["id"], r["sim"]) for r in out.where("query_id <> 'v00007'").collect())
    assert rows(index.exact(queries, 10)) == rows(want)
    assert index.calibrated(queries, 10) <= 5 and 50 <= len(index.centres()[0]) <= 54
    assert index.exact(queries.where("query_id = 'v00007'"), 10).select("sim").distinct().collect() == [(0.0,)]  # zero is as far from all


def test_index_of_odd_tables(spark, tmp_path):
    df = frame(spark, clustered(100))
    zero = df.where("id = 'v00007'")
    queries = df.select(F.col("id").alias("query_id"), "vec")
    index = VectorIndex.build(zero, f"file://{tmp_path}/none")
    assert index.exact(queries, 3).collect() == [] and index.calibrated(queries, 3) == 1
    with pytest.raises(ValueError, match="anew"):
        index.add(df)
    one = VectorIndex.build(df.limit(1), f"file://{tmp_path}/one")
    one.add(df.where("id <> 'v00000'"))
    assert one.rows().count() == 99
    got = one.exact(queries.where("query_id = 'v00050'"), 1).first()
    assert (got["id"], got["sim"]) == ("v00050", 1.0)
