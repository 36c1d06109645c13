"""Cases of the review: results that a cut or a filter had left out."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.functions import vectors
from lorehouse.operators import gate
from lorehouse.plans import knowledge
from lorehouse.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sims():
    """All pairs' cosines to 6 places, by whether the labels agree."""
    rows = duckdb.sql(f"SELECT embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    v = np.array([r[0] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label, (i, j) = np.array([r[1] for r in rows]), np.triu_indices(len(rows), 1)
    s = np.round(np.clip((v @ v.T)[i, j], -1, 1), 6)
    return {dup: s[(label[i] == label[j]) == dup] for dup in (False, True)}


def test_sweep_counts_pairs_of_any_similarity(spark, sims):
    rows = {round(r["threshold"] * 200): r for r in knowledge.threshold_sweep(spark, SF).collect()}
    assert sorted(rows) == list(range(40, 121)) and rows[40]["recall"] < 0.1
    for i, r in rows.items():
        tp, fp = (int((np.floor(sims[dup] * 200) >= i).sum()) for dup in (True, False))
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, len(sims[True]) - tp)
        assert r["recall"] == pytest.approx(tp / len(sims[True]), abs=1e-6)
    assert knowledge.operating_points(spark, SF).first()["recall_threshold"] is None  # none in 0.2 to 0.6 holds 0.9 of them


def test_stats_are_of_pairs_of_any_similarity(spark, sims):
    for r in knowledge.similarity_stats(spark, SF).collect():
        s = sims[r["dup"]]
        assert r["n"] == len(s) and r["min"] == s.min() < 0 and r["max"] == s.max()
        want = [*np.quantile(s, [0.1, 0.25, 0.5, 0.75, 0.9]), s.mean()]
        assert [r[c] for c in ("p10", "p25", "median", "p75", "p90", "mean")] == pytest.approx(want, abs=1.1e-6)


def test_similarity_counts_by_blocks(spark):
    v = tables.vectors(spark, SF).withColumn("label", F.when(F.col("ord") % 50 > 0, F.col("label")))
    got = [sorted(vectors.similarity_counts(v, block).collect(), key=repr) for block in (8192, 90)]
    assert got[0] == got[1] and sum(r["n"] for r in got[0]) == 500 * 499 // 2
    assert sum(r["n"] for r in got[0] if r["dup"] is None) == 500 * 499 // 2 - 490 * 489 // 2


def test_gate_takes_earlier_entries_before_any_rank(spark, capsys):
    rows = [("a", 0, [1.0, 0.1]), ("b", 1, [1.0, 0.0]), *((f"c{i}", 2 + i, [1.0, i / 1e6]) for i in range(20))]
    e = spark.createDataFrame(rows, "id string, ord long, vec array<double>").withColumns({c: F.lit("fact") for c in ("content_type", "user_id", "subject")})
    e = e.withColumns({"content": F.col("id"), "flag": F.lit(None).cast("string")})
    out = gate.decide(e.where("ord > 0"), e.where("ord = 0"), ["content_type"], 0.45, 0.35)
    assert [(r["decision"], r["against"]) for r in out.where("id = 'b'").collect()] == [("refuse", "a")]
    out.explain()
    assert "Window" not in capsys.readouterr().out  # no rank cuts the candidates of an entry
