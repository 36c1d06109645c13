"""The table function that distils, and the importers' log."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lorehouse.operators import distil, synclog

GOOD = {"summary": " s ", "claims": [{"type": "decision", "content": f" c{i} ", "qualitative_confidence": "firm", "topics": ["a", 1], "people": "x"} for i in range(7)]}


def test_answers_are_parsed_or_say_what_they_lack():
    for wrap in ("{}", "```json\n{}\n```", "```\n{}```", "Sure: {} bye", "﻿{}"):
        got = distil.parsed(wrap.replace("{}", json.dumps(GOOD)))
        assert got["summary"] == "s" and len(got["claims"]) == 5
    for raw, lack in ((None, "not JSON"), ("", "not JSON"), ("[1]", "not JSON"), ('{"summary": " ", "claims": [1]}', "no summary"), ('{"summary": "s"}', "no claims"), ('{"summary": "s", "claims": []}', "no claims"), (json.dumps(GOOD | {"claims": [*GOOD["claims"][:2], 7]}), "claim 2"), (json.dumps(GOOD).replace('"firm"', '"sure"', 1), "claim 0")):
        with pytest.raises(ValueError, match=lack):
            distil.parsed(raw)


def test_a_model_is_called_from_sql(spark):
    good = json.dumps(GOOD)

    def load():
        def model(text):
            if text == "boom":
                raise RuntimeError("down")
            return good if text else None

        return model

    distil.register(spark, "distil_test", load)
    spark.createDataFrame([("a", "x", 1), ("b", "boom", 2), ("c", None, 3)], "id string, content string, more int").createOrReplaceTempView("distil_docs")
    rows = spark.sql("SELECT * FROM distil_test(TABLE(SELECT id, content FROM distil_docs)) ORDER BY id, place").collect()
    assert [(r["place"], r["type"], r["content"], r["confidence"], r["topics"], r["people"]) for r in rows if r["id"] == "a"] == [(0, "summary", "s", None, None, None)] + [(i + 1, "decision", f"c{i}", 0.9, ["a"], []) for i in range(5)]
    assert {r["id"]: r["error"] for r in rows if r["place"] is None} == {"b": "RuntimeError: down", "c": "not JSON"}


def test_log_of_files(spark, tmp_path):
    log = synclog.SyncLog(spark, f"file://{tmp_path}/log")
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), (None, "1")], "path string, sha256 string")
    log.record(files.withColumns({"whole_doc_id": F.when(F.col("path") != "b", F.col("path")), "last_error": F.when(F.col("path") == "b", "failed")}))
    next_ = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "path string, sha256 string")
    want = {"a": "skip", "b": "retry", "c": "update", "d": "new"}
    plan = lambda x: {r["path"]: r["action"] for r in x.plan(next_).collect()}
    assert plan(log) == want
    log.record(next_.where("path = 'b'").withColumn("whole_doc_id", F.lit("k")))
    log.record(next_.where("path = 'd'").withColumn("whole_doc_id", F.lit("k")))
    want |= {"b": "skip", "d": "skip"}
    assert plan(log) == want and len(log._parts()) == 3
    log.compact()
    again = synclog.SyncLog(spark, f"file://{tmp_path}/log")
    assert plan(again) == want and len(again._parts()) == 1 and again.set_aside == [] and again.rows().count() == 4
    # a part that broke off is not there
    (tmp_path / "log" / "v1" / "part-9-x").mkdir()
    assert plan(again) == want


def test_log_of_another_version_is_set_aside(spark, tmp_path):
    (tmp_path / "v7" / "part-0-x").mkdir(parents=True)
    (tmp_path / "v7" / "part-0-x" / "data").write_text("kept")
    log = synclog.SyncLog(spark, str(tmp_path))
    assert len(log.set_aside) == 1 and (tmp_path / log.set_aside[0] / "part-0-x" / "data").read_text() == "kept"
    assert log.rows().count() == 0 and synclog.SyncLog(spark, str(tmp_path)).set_aside == []


def test_log_of_ids_holds_no_failures(spark, tmp_path):
    log = synclog.SyncLog(spark, str(tmp_path), files=False)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert log.plan(ids).count() == 3
    log.record(ids.where("id <> 'b'"))
    log.record(ids.where("id = 'a'"))
    assert log.plan(ids).collect() == [("b", "new")] and log.plan(ids, force=True).count() == 3
    log.compact()
    assert log.plan(ids).collect() == [("b", "new")] and log.rows().count() == 2


def test_watermark_only_moves_forward(spark, tmp_path):
    mark = synclog.Watermark(spark, f"file://{tmp_path}/mark", keep=3)
    assert mark.read() == (None, []) and mark.since() is None and mark.since("2024-01-01") == "2024-01-01"
    rows = lambda *given: spark.createDataFrame(list(given), "id string, s string, e string").select("id", F.to_timestamp("s").alias("start"), F.to_timestamp("e").alias("end"))
    mark.advance(rows(("a", "2024-01-01", "2024-01-05"), ("b", "2024-01-02", None)))
    assert mark.read() == ("2024-01-05 00:00:00.000000", ["a", "b"])
    mark.advance(rows(("c", "2023-01-01", "2023-01-05"), ("a", "2024-01-01", None)))
    assert mark.read() == ("2024-01-05 00:00:00.000000", ["b", "c", "a"])
    mark.advance(rows(("d", "2024-02-01", "2024-02-05")))
    assert mark.read() == ("2024-02-05 00:00:00.000000", ["c", "a", "d"]) and mark.since("2024-01-01") == mark.read()[0]
    last = sorted((tmp_path / "mark").glob("mark-2/part-*"))[0]
    (tmp_path / "mark" / "mark-2" / f".{last.name}.crc").unlink(missing_ok=True)
    last.write_text("{broken")
    assert synclog.Watermark(spark, f"file://{tmp_path}/mark").read() == (None, [])
