from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorehouse.functions import rules
from lorehouse.functions import text as T
from lorehouse.operators import analytics, evaluation, gate, graph, ingest, search, substrings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalise(spark):
    assert one(spark, T.normalise(F.lit("\n\n  a \t b  c  \r\nd\r\n\n"))) == "  a b c\nd"


def test_relevance_words_not_substrings(spark):
    assert one(spark, T.relevance(F.lit("cats category"), "cat")) == pytest.approx(0.7 + 0.15 / 5)
    assert one(spark, T.relevance(F.lit("é a xéa"), "the of")) == 0.0
    assert one(spark, T.relevance(F.lit("Caching is cached"), "cache")) == pytest.approx(0.7 + 0.15 * 2 / 5)


def test_recency(spark):
    assert one(spark, T.recency(F.lit("2025-01-01").cast("timestamp"), F.lit("2025-04-01"))) == pytest.approx(0.5)
    assert one(spark, T.recency(F.lit(None).cast("timestamp"), F.lit("2025-04-01"))) == 0.5
    assert one(spark, T.recency(F.lit("2026-01-01").cast("timestamp"), F.lit("2025-04-01"))) == 1.0


def test_inference(spark):
    got = one(spark, rules.inference(F.lit("I fixed the bug: the solution was to configure OAuth in python first"), {"sign-in": "OAuth|JWKS"}))
    assert got["content_type"] == "procedure"
    assert got["project"] == "sign-in"
    assert got["language"] == "python"
    assert got["tags"] == ["sign-in", "python", "procedure"]


def test_merge_prefers_longer_and_unites(spark):
    a = spark.createDataFrame([("1", "long text", 0.2, 0)], "id string, content string, confidence double, ord long")
    b = spark.createDataFrame([("1", "text", 0.9, 0), ("2", "x", 0.1, 1)], "id string, content string, confidence double, ord long")
    for arms in ([("graph", a), ("mongodb", b)], [("mongodb", b), ("graph", a)]):
        got = {r["key"]: r for r in search.merge(arms).collect()}
        assert (got["1"]["content"], got["1"]["confidence"], set(got["1"]["systems"])) == ("long text", 0.9, {"graph", "mongodb"})


def test_rrf(spark):
    lexical = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, lexical_rank int")
    vector = spark.createDataFrame([(1, "b", 1)], "query_id long, id string, vector_rank int")
    got = {r["id"]: r["rrf"] for r in search.rrf(lexical, vector).collect()}
    assert got == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6)}


def test_relationships_cap_and_order(spark):
    rows = [("h", f"n{i:02}", "R", 50, i) for i in range(30)] + [("x", "h", "R", 1, 0), ("h", "n00", "R", 9, 99), ("h", None, "R", 1, 1)]
    e = spark.createDataFrame(rows, "src string, dst string, type string, strength int, ord long")
    entries = spark.createDataFrame([("n00", "hello")], "id string, content string")
    got = [r for r in graph.relationships(e, entries).collect() if r["node"] == "h"]
    assert len(got) == 25 and {r["direction"] for r in got} == {"out"}
    assert next(r for r in got if r["other"] == "n00")["preview"] == "hello"


def test_metrics(spark):
    j = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "query_id long, rank int, rel int")
    assert evaluation.precision_at_k(j, 5).first()["precision"] == 0.4
    assert evaluation.reciprocal_rank(j).first()["rr"] == 0.5
    with pytest.raises(ValueError):
        evaluation.precision_at_k(j, -1)


def test_gate_exact_first_by_arrival(spark):
    rows = [("a", 1, "same  text", None), ("b", 2, "same text", None), ("c", 0, "same text", "DELETED")]
    e = spark.createDataFrame(rows, "id string, ord long, content string, flag string").withColumns({c: F.lit("x") for c in ("user_id", "content_type", "subject")})
    assert {r["id"]: r["duplicate_of"] for r in gate.exact(e).collect()} == {"a": None, "b": "a", "c": None}


def test_merge_speakers(spark):
    rows = [("m", 0, "a", "x", True), ("m", 1, "a", " y ", None), ("m", 2, "b", "z", True), ("m", 3, "b", "no", False), ("m", 4, "a", "w", True)]
    s = spark.createDataFrame(rows, "meeting string, ord int, source string, text string, is_final boolean")
    assert sorted((r["turn"], r["source"], r["text"]) for r in ingest.merge_speakers(s).collect()) == [(1, "a", "x y"), (2, "b", "z"), (3, "a", "w")]


def test_pack_paragraphs(spark):
    d = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccccccccccccccc")], "id long, t string")
    assert [r["text"] for r in ingest.pack_paragraphs(d, "id", "t", 10).orderBy("chunk").collect()] == ["aaaa\n\nbbbb", "cccccccccccccccc"]


def test_vector_health(spark):
    h = lambda a, b, c, ok=True: one(spark, analytics.vector_health(F.lit(a), F.lit(b), F.lit(c), F.lit(ok)))
    assert [h(100, 100, 100), h(100, 90, 100), h(50, 50, 100), h(0, 0, 10), h(1, 1, 1, False)] == ["ok", "degraded", "degraded", "missing", "unknown"]


def test_strings_in_texts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé😀 .") for _ in range(n))
    needles, texts = [word(rng.randrange(8)) for _ in range(120)] + [None, "abab.b" * 3], [(i, word(rng.randrange(40))) for i in range(150)] + [(900, None), (901, ""), (902, "x" + "abab.b" * 9)]
    want = {(i, x) for i, t in texts if t for x in needles if x and x in t}
    for few in (substrings.FEW, 20):
        got = substrings.contained(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "id long, text string"), few).collect()
        assert len(got) == len(want) and {(r["id"], r["needle"]) for r in got} == want


def test_rows_by_a_query_vector(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [1.0, 1.0]), ("d", 3, [0.0, 0.0]), ("e", 4, [2.0, 2.0])], "id string, ord long, vec array<double>")
    got = [(r["id"], round(r["similarity"], 6)) for r in search.arm_vector(rows, [1.0, 1.0], 3).collect()]
    assert got == [("c", 1.0), ("e", 1.0), ("a", 0.707107)]


def test_pairs_that_a_judge_is_asked(spark):
    rows = [("x", "y", "confirm"), ("x", "y", "confirm"), ("x", "z", "confirm"), ("x", "w", "refuse"), ("v", "w", "confirm")]
    pairs = spark.createDataFrame(rows, "new_content string, candidate_content string, band string")
    known = pairs.where("candidate_content = 'z'").select(T.pair_key(F.col("new_content"), F.col("candidate_content")).alias("key"))
    got = gate.unjudged(pairs, known)
    assert sorted((r["new_content"], r["candidate_content"]) for r in got.collect()) == [("v", "w"), ("x", "y")]


def test_minutes_by_strategy(spark):
    got = spark.createDataFrame([(s,) for s in ("aggressive", "conservative", "realtime")], "s string").select("s", rules.strategy_ttl_minutes(F.col("s")).alias("m"))
    assert {r["s"]: r["m"] for r in got.collect()} == {"aggressive": 60, "conservative": 30, "realtime": 0}
