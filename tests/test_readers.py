"""JSON members, sidecars and text files against plain json, and what is wrong with files."""

from __future__ import annotations

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from lorehouse.sources import readers


def read(text, path=(), chunk=3):
    return list(readers.members(readers._Text(io.BytesIO(text if isinstance(text, bytes) else text.encode()), chunk), path))


def value(rng, depth=0):
    kind = rng.randrange(4 if depth > 3 else 6)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice(("a", 'q"', "\\", "é{", "b]", "")) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return (rng.choice((None, True, False)), rng.randrange(-999, 999) / 4, rng.choice(('x"y', "{[", "\\\\", "ü\n😀", "")), 7)[kind]


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 1 << 20])
def test_members_are_those_of_json(chunk):
    rng = random.Random(chunk)
    for _ in range(60):
        inner = {f"k{i}": value(rng) for i in range(rng.randrange(4))}
        top = {"skip": value(rng), "at": {"more": value(rng), "here": inner}, "last": value(rng)}
        text = json.dumps(top, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 2)))
        assert {k: json.loads(v) for k, v in read(text, ["at", "here"], chunk)} == inner
        assert {k: json.loads(v) for k, v in read(text, (), chunk)} == top
        items = [value(rng) for _ in range(rng.randrange(5))]
        assert [json.loads(v) for _, v in read(json.dumps(items), ["[]"], chunk)] == items


@pytest.mark.parametrize(
    ("text", "path", "problem"),
    [("", (), "empty"), ("  ", ["[]"], "empty"), ("7", (), "neither"), ('{"a": 1', (), "early"), ('{"a": "x', (), "early"), ('{"a": [1, {"b": 2}', (), "early"), ('{"a" 1}', (), "':' is missing"), ('{"a": 1 "b": 2}', (), "',' is missing"), ("{1: 2}", (), "key"), ('{"a": }', (), "no value"), ('{"a": 1}', ["b"], "no b"), ('{"a": 1}', ["a", "b"], "no b"), ('{"a": 1}', ["[]"], "not an array"), (b'{"a": "\xff"}', (), "UTF-8")],
)
def test_problems_are_named(text, path, problem):
    with pytest.raises(readers.Malformed, match=problem):
        read(text, path)


def test_a_value_at_a_time_is_held():
    text = readers._Text(io.BytesIO(json.dumps({str(i): "x" * 1000 for i in range(2000)}).encode()), 4096)
    for _ in readers.members(text):
        assert len(text.buffer) < 20_000


def test_files_and_filters(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text('{"x": {"n": 1}, "y": 5}')
    (tmp_path / "deep" / "b.json").write_text('{"x": {"n": 2}} {')
    (tmp_path / "_c.json").write_text("not read")
    rows = readers.json_members(spark, f"file://{tmp_path}")
    got = [(r["file"][-6:], r["key"], r["value"], r["problem"]) for r in rows.orderBy("file", F.asc_nulls_last("key")).collect()]
    assert got == [("a.json", "x", '{"n": 1}', None), ("a.json", "y", "5", None), ("b.json", "x", '{"n": 2}', None), ("b.json", None, None, "more than one value")]
    few = rows.where("key = 'x'")
    assert [r["value"] for r in few.orderBy("file").collect()] == ['{"n": 1}', '{"n": 2}']
    assert "EqualTo" not in few._jdf.queryExecution().optimizedPlan().toString() and rows.where("key in ('y', 'z')").count() == 1
    entries = readers.read_sidecar(spark, str(tmp_path), "n int")
    assert sorted((r["id"] or "", r["n"] or 0, r["problem"] or "") for r in entries.collect()) == [("", 0, "more than one value"), ("x", 1, ""), ("x", 2, ""), ("y", 0, "entry")]
    with pytest.raises(Exception, match="nowhere"):
        readers.json_members(spark, f"{tmp_path}/nowhere").count()


def test_sidecar_writes_are_whole(spark, tmp_path):
    df = spark.range(50).select(F.concat(F.lit('a"'), "id").alias("id"), (F.col("id") * 2).alias("n"), F.when(F.col("id") % 3 == 0, "é\n").alias("t")).repartition(4)
    back = lambda: sorted((r["id"], r["n"], r["t"]) for r in readers.read_sidecar(spark, str(tmp_path), "n long, t string").collect())
    readers.write_sidecar(df, str(tmp_path))
    want = sorted((r["id"], r["n"], r["t"]) for r in df.collect())
    assert back() == want and all(json.loads(p.read_text()) for p in tmp_path.iterdir())
    with pytest.raises(Exception, match="broke"):
        readers.write_sidecar(df.withColumn("n", F.when(F.col("n") == 60, F.raise_error(F.lit("broke"))).otherwise(F.col("n"))), str(tmp_path))
    assert back() == want and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    readers.write_sidecar(df.where("id = 'a\"7'"), str(tmp_path))
    assert back() == [('a"7', 14, None)]
    readers.write_sidecar(df.where("id = 'a\"8'"), str(tmp_path), overwrite=False)
    assert len(back()) == 2
    with pytest.raises(Exception, match="columns"):
        df.write.format("sidecar").option("path", str(tmp_path)).mode("append").save()


def test_tree_without_folders(spark, tmp_path):
    assert readers.markdown_tree(spark, [f"{tmp_path}/none"]).count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.md").write_text("x")
    (tmp_path / "r" / "s").mkdir()
    (tmp_path / "r" / "s" / "b.md").write_text("y")
    tree = readers.markdown_tree(spark, [f"{tmp_path}/r", f"{tmp_path}/r/s"], [f"{tmp_path}/r"])  # one row a path, whichever root leads there
    assert sorted((r["path"][-4:], r["project"], r["content"]) for r in tree.collect()) == [("a.md", "r", "x"), ("b.md", "r", "y")]
    assert readers.markdown_tree(spark, [f"{tmp_path}/r"], after="2999-01-01").count() == 0
