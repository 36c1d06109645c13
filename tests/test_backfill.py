"""A backfill that is killed, run again, and held against a model that fails."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorehouse.functions import vectors
from lorehouse.operators import backfill


def entries(spark, n=60):
    return spark.range(n).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("text "), "id").alias("content"), F.when(F.col("id") % 5 == 0, "old").alias("embedder_id"))


def test_failures_are_rows(spark):
    def odd(texts):
        """Raises on one text, gives too few numbers, infinities or nothing on others."""
        if "raise" in texts:
            raise RuntimeError("down")
        return [{"short": [1.0], "inf": [float("inf")] * 4, "none": None}.get(t, [float(len(t))] * 4) for t in texts]

    df = spark.createDataFrame([(t, t) for t in ("a", "raise", "short", "inf", "none", "bb")] + [("null", None)], "id string, content string").coalesce(1)
    got = {r["id"]: (r["vec"], r["tries"], r["error"]) for r in backfill.embedded(df, lambda: odd, "odd", 4, 3).collect()}
    assert got["a"] == ([1.0] * 4, 2, None) and got["bb"][0] == [2.0] * 4 and got["null"][0] == [0.0] * 4
    assert {i: got[i][2] for i in ("raise", "short", "inf", "none")} == {"raise": "RuntimeError: down", "short": "1 dimensions, not 4", "inf": "not finite", "none": "no vector"}
    assert all(got[i][:2] == (None, 3) for i in ("raise", "short", "inf", "none"))


def test_killed_and_run_again_writes_each_vector_once(spark, tmp_path, monkeypatch):
    fill = backfill.Backfill(spark, f"file://{tmp_path}/v", lambda: backfill.HashedWords(4), "h4", 4)
    real, calls = backfill.embedded, []

    def breaks(work, *rest):
        calls.append(1)
        out = real(work, *rest)
        return out if len(calls) < 3 else out.withColumn("error", F.when(F.rand() < 2, F.raise_error(F.lit("killed"))))

    monkeypatch.setattr(backfill, "embedded", breaks)
    with pytest.raises(Exception, match="killed"):
        fill.run(entries(spark), 10)
    done = {r["id"] for r in fill.vectors().collect()}
    assert 0 < len(done) < 48
    monkeypatch.setattr(backfill, "embedded", real)
    assert fill.run(entries(spark), 10) == -(-(48 - len(done)) // 10)
    ids = [r["id"] for r in fill.rows().collect()]
    assert len(ids) == len(set(ids)) == 48 and fill.run(entries(spark), 10) == 0
    want = {r["id"]: r["v"] for r in entries(spark).select("id", vectors.hashed_words(F.col("content"), 4).alias("v")).collect()}
    assert all(r["vec"] == want[r["id"]] for r in fill.vectors().collect())
    assert fill.failures().count() == 0 and fill.pending(entries(spark)).count() == 0


def test_vectors_stored_afterwards(spark):
    e = entries(spark, 6)
    v = spark.createDataFrame([("e1", "a", [1.0, 2.0]), ("e1", "b", [3.0, 4.0]), ("e2", "a", [1.0]), ("e3", "a", [1.0, float("nan")]), ("e4", "a", None), ("x", "a", [1.0, 1.0])], "id string, embedder_id string, vec array<double>")
    got = {r["id"]: (r["vec"], r["embedder_id"], r["embedded_at"] is not None) for r in backfill.stored(e, v, 2, "2025-01-01").collect()}
    assert got == {"e0": (None, "old", False), "e1": ([3.0, 4.0], "b", True), "e5": (None, "old", False)} | {f"e{i}": (None, None, False) for i in (2, 3, 4)}
