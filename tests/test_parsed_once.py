"""A node's properties are parsed once, not once a property that is read."""

from __future__ import annotations

from lorehouse.plans import importing
from lorehouse.sources import exchange


def test_parsed_once(spark):
    rows = [("a", ["Person"], '{"name": "n", "notes": " ", "x-y": 1, "x_y": 2}'), ("b", [], "{broken"), ("c", None, None), ("d", [], "{}")]
    m = exchange.migrated_nodes(spark.createDataFrame(rows, "element string, labels array<string>, props string"), "2025-01-01")
    assert m._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    got = {r["element"]: r for r in m.collect()}
    assert sorted(got) == ["a", "d"] and (got["a"]["content"], got["d"]["content"]) == ("n", "d")
    assert got["a"]["metadata"]["x_y"] == "2" and got["d"]["metadata"] == {}


def test_small_files_are_dealt_out(spark):
    assert importing._graph_dump(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
