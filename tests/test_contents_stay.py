"""What a batch decides and changes shuffles no contents of entries that it doesn't touch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorehouse.operators import gate, store
from lorehouse.sources import scratch


def rows(spark, n, action=None, **given):
    r = spark.range(n).select(F.concat(F.lit(given.get("name", "e")), "id").alias("id"), (F.col("id") + given.get("since", 0)).alias("ord"), F.concat(F.lit(given.get("text", "text ")), F.col("id") % 7).alias("content"), F.lit("u").alias("user_id"), F.lit("fact").alias("content_type"), F.lit("s").alias("subject"), F.lit("personal").alias("source"), F.lit(0.5).alias("confidence"), F.lit("2025-01-01").cast("timestamp").alias("ts"))
    if action:
        r = r.withColumns({"action": F.lit(action), "target_id": F.concat(F.lit("e"), F.col("ord") % 3), "reason": F.col("id"), "skip_dedup": F.lit(False), "metadata": F.create_map(F.lit("k"), F.col("id")), "vec": F.lit(None).cast("array<double>")})
    return r


@pytest.mark.parametrize("most", [scratch.SENT_ROWS, 1])
def test_changed_entries_are_sent(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "SENT_ROWS", most)
    s = store.Store(spark, scratch.folder(spark))
    s.load(rows(spark, 20))
    for b, action in enumerate(("update", "supersede"), 1):
        s.apply(rows(spark, 5, action, name=f"{action}-", since=100 * b, text="new "), b)
    got = {r["id"]: r for r in s.entries().collect()}
    assert len(got) == 25 and [got[f"e{i}"]["superseded_by"] for i in range(4)] == ["supersede-4", "supersede-2", "supersede-3", None]
    assert [got[f"e{i}"]["content"] for i in range(4)] == ["new 2", "new 3", "new 4", "text 3"] and len(got["e1"]["update_history"]) == 2
    plan = s.entries()._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most > 1)


def test_existing_entries_need_no_content(spark):
    e = rows(spark, 30).withColumns({"flag": F.lit(None).cast("string"), "vec": F.lit(None).cast("array<double>")})
    old, new = e.where("ord < 5"), e.where("ord >= 5")
    want = gate.decide(new, old, ["content_type"], 0.9, 0.8).collect()
    got = gate.decide(new, gate.fingerprinted(old).drop("content"), ["content_type"], 0.9, 0.8).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r["decision"] for r in got} == {"exact", "pass"}
