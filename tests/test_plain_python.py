"""What SQL can't express, and the larger operators, against plain Python on small tables."""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.functions import rules
from lorehouse.functions import text as T
from lorehouse.operators import corrections, evaluation, gate, graph, people, search
from lorehouse.plans import curation, knowledge
from lorehouse.sources import exchange, tables

SF = "/root/testdata/sf0.001"


def plain_gate(new, existing, refuse, confirm):
    """One entry after the other: copies first, then the nearest of those there."""
    there, out = [e for e in existing if not e["flag"]], {}
    key = lambda e: (e["user_id"], e["content"], e["content_type"], e["subject"])
    for e in sorted((e for e in new if not e["flag"]), key=lambda e: e["ord"]):
        copies = [x for x in there if key(x) == key(e)]
        near = []
        if e["vec"] is not None:
            a = np.array(e["vec"])
            for i, x in enumerate(there):
                if x["vec"] is not None and x["content_type"] == e["content_type"]:
                    b = np.array(x["vec"])
                    near.append((float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), x))
        top = max(near, key=lambda y: y[0], default=None)
        if copies:
            out[e["id"]] = ("exact", copies[0]["id"])
        elif top and top[0] >= confirm:
            out[e["id"]] = ("refuse" if top[0] >= refuse else "confirm", top[1]["id"])
        else:
            out[e["id"]] = ("pass", None)
            there.append(e)
    return out


def test_gate_takes_entries_one_by_one(spark):
    rng = random.Random(4)
    rows = [{"id": f"e{i}", "ord": i, "content": f"text {rng.randrange(60)}", "content_type": rng.choice(("fact", "memory")), "user_id": "u", "subject": None, "flag": "DELETED" if i % 23 == 5 else None, "vec": None if i % 9 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]} for i in range(140)]
    df = spark.createDataFrame(rows, "id string, ord long, content string, content_type string, user_id string, subject string, flag string, vec array<double>")
    got = {r["id"]: (r["decision"], r["against"]) for r in gate.decide(df.where("ord >= 20"), df.where("ord < 20"), ["content_type"], 0.97, 0.9).collect()}
    assert got == plain_gate(rows[20:], rows[:20], 0.97, 0.9)
    assert {d for d, _ in got.values()} == {"exact", "refuse", "confirm", "pass"}


def test_gate_batch_query(spark):
    rows = [r.asDict() for r in knowledge._by_content(spark, SF).join(tables.vectors(spark, SF).select("id", "vec"), "id", "left").where("flag is null").collect()]
    there = [r for r in rows if r["source"] == "cross_domain"]
    norm = spark.createDataFrame([(r["id"], r["content"]) for r in rows], "id string, content string").select("id", T.normalise(F.col("content")).alias("n")).collect()
    texts = {r["id"]: r["n"] for r in norm}
    for r in rows:
        r["content"] = texts[r["id"]]
    want = plain_gate([r for r in rows if r["source"] != "cross_domain"], sorted(there, key=lambda r: r["ord"]), knowledge.REFUSE, knowledge.CONFIRM)
    got = {r["id"]: r["decision"] for r in knowledge.gate_batch(spark, SF).collect()}
    assert got == {i: d for i, (d, _) in want.items()}


def test_greedy_pairs(spark):
    rng = random.Random(5)
    rows = list({(a, b): (a, b, round(rng.random(), 2)) for a, b in ((f"n{min(x)}", f"n{max(x)}") for x in (rng.sample(range(40), 2) for _ in range(300)))}.values())
    used, want = set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(want) < 15 and not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame(rows, "a string, b string, sim double")
    got = evaluation.greedy_pairs(df, 15).orderBy("place").collect()
    assert [(r["a"], r["b"], r["sim"]) for r in got] == want
    assert evaluation.greedy_pairs(df.limit(0), 15).count() == 0
    top = curation.distinct_pairs_greedy(spark, SF).collect()
    assert len({x for r in top for x in (r["a"], r["b"])}) == 2 * len(top) <= 30


def plain_inference(c):
    f = lambda p: bool(re.search(p, c, re.I | re.A))
    scores = {t: sum(map(f, ps)) / len(ps) for t, ps in rules.TYPE_PATTERNS.items()}
    best = max(scores.values())
    first = lambda d: next((n for n, p in d.items() if f(p)), None)
    kind = next((t for t in scores if scores[t] == best > 0), "fact")
    return kind, round(min(0.9, 0.5 + best * 0.4), 4), first(tables.PROJECTS), first(rules.TIMES), first(rules.LANGUAGES), [n for n, p in rules.FRAMEWORKS.items() if f(p)], [m[0] for m in re.finditer(rules.HABIT, c, re.I | re.A)][:3]


def test_inference_against_the_patterns(spark):
    rng = random.Random(1)
    pool = "I my think feel want remember last time recall realize aha turns out it seems always pattern every time bug fix solution issue step 5 then to do install version 1.2 enabled url : = api relates to causes result in depends on foo.ts type x =y const python .py def import pip rust fn impl go golang func next.js nextjs express app.get match mem0 ttl cache mcp today right now last week going to never OAuth knowledge base \n É ñ".split(" ")
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += ["last  time", "xalways", "alwaysé", "I\nthink", "I think", "think I", "version\n1.2", "port=", "a.tsx .ts x.ts", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", rules.inference(F.col("t"), tables.PROJECTS).alias("x")).collect():
        x = r["x"]
        assert (x["content_type"], round(x["confidence"], 4), x["project"], x["temporal"], x["language"], x["frameworks"], x["patterns"]) == plain_inference(texts[r["i"]]), texts[r["i"]]


def test_mentions_in_blocks_of_names(spark):
    rng = random.Random(2)
    words = ["anna", "bert", "carl", "dora", "an", "Émil", "anna bert"]
    names = [(i, " ".join(rng.sample(words, 2)), [rng.choice(words)]) for i in range(30)]
    texts = [(f"d{i}", " ".join(rng.choice(words) for _ in range(12)).title() if i % 7 else None) for i in range(60)]
    c, e = spark.createDataFrame(texts, "id string, content string"), spark.createDataFrame(names, "entity long, name string, aliases array<string>")
    want = {(d, i) for d, t in texts if t for i, n, al in names if any(len(x) > 3 and x.lower() in t.lower() for x in (n, *al))}
    for block in (50_000, 7):
        got = graph.mentions(c, e, block).collect()
        assert len(got) == len(want) and {(r["id"], r["entity"]) for r in got} == want


def test_related_prunes_hubs_without_loss(spark):
    rng = random.Random(3)
    edges = [("hub", f"n{i:03}") for i in range(150)] + [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(60)] + [("leaf", "hub")]
    near: dict[str, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    e = spark.createDataFrame([(a, b, "RELATED_TO", 1, i) for i, (a, b) in enumerate(edges)], "src string, dst string, type string, strength int, ord long")
    got: dict[str, list] = {}
    for r in graph.related(e, spark.createDataFrame([(x,) for x in near], "start string")).collect():
        got.setdefault(r["start"], []).append((r["distance"], r["node"]))
    for x in near:
        one = near[x] - {x}
        two = set().union(*(near[y] for y in one), set()) - one - {x}
        assert sorted(got[x]) == sorted([(1, y) for y in one] + [(2, y) for y in two])[:20]


def test_batch_relevance_and_its_pruning(spark):
    live = search.facets(tables.entries(spark, SF))
    queries = tables.search_queries(spark, SF)
    every = {(r["query_id"], r["id"]): r["relevance"] for r in search.relevance_batch(live, queries).collect()}
    some = {(r["query_id"], r["id"]): r["relevance"] for r in search.relevance_batch(live, queries, top=5).collect()}
    assert all(every[k] == v for k, v in some.items()) and len(some) < len(every)
    for q in {q for q, _ in every}:
        top = sorted((-round(v, 6) for (p, _), v in every.items() if p == q))[:5]
        assert sorted(-round(v, 6) for (p, _), v in some.items() if p == q)[:5] == top
    text = queries.first()
    one = {r["id"]: r["r"] for r in live.select("id", T.relevance(F.col("content"), text["query"]).alias("r")).collect() if r["r"] > 0}
    assert one == pytest.approx({i: v for (q, i), v in every.items() if q == text["query_id"]})


def test_fusion_weights_and_ties(spark):
    lexical = spark.createDataFrame([(1, "a", 1), (1, "B", 1), (1, "c", 1)], "query_id long, id string, lexical_rank int")
    vector = spark.createDataFrame([(1, "d", 1)], "query_id long, id string, vector_rank int")
    f = search.rrf(lexical, vector, weights=(1.0, 0.5)).withColumn("recency", F.when(F.col("id") == "c", 0.9).otherwise(0.5)).withColumn("lexical", F.lit(0.5))
    assert [r["id"] for r in f.orderBy(*search.fused_order()).collect()] == ["c", "B", "a", "d"]
    assert search.clamp(500, 10, 50) == 50 and search.clamp(0, 1, 100) == 1


def test_corrections_of_one_entry_by_several(spark):
    e = spark.createDataFrame([("a", "x", 0.1, None), ("b", "y", 0.2, None)], "id string, content string, confidence double, flag string").withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "flag_date": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string")})
    u = spark.createDataFrame([("a", "one", None, "n1", 1), ("a", None, 0.7, "n2", 2)], "id string, new_content string, new_confidence double, note string, ord long")
    got = {r["id"]: r for r in corrections.update(e, u, "2025-01-01").collect()}
    assert len(got) == 2 and (got["a"]["content"], got["a"]["confidence"], got["a"]["update_history"]) == ("one", 0.7, ["n1", "n2"])
    f = spark.createDataFrame([("b", "DELETED", None, 1), ("b", "SUPERSEDED", "a", 2)], "id string, new_flag string, new_successor string, ord long")
    out = corrections.flag(e, f, "2025-01-01").collect()
    assert len(out) == 2 and {(r["id"], r["flag"], r["superseded_by"]) for r in out} == {("a", None, None), ("b", "SUPERSEDED", "a")}
    r = spark.createDataFrame([("b", "s2", 7, 2), ("b", "s1", 7, 1), ("b", "s0", 3, 0)], "old_id string, new_id string, ts long, ord long")
    orphan = e.withColumn("flag", F.lit("SUPERSEDED"))
    assert {x["id"]: x["repair_to"] for x in corrections.classify_superseded(orphan, r).collect()} == {"a": None, "b": "s1"}


def test_short_document_queries_match_nothing(spark):
    e = spark.createDataFrame([("x", ["t"])], "content string, tags array<string>")
    assert e.where(search.keyword_match("a b", without=False)).count() == 0 and e.where(search.keyword_match("a b")).count() == 1


def test_exchange_counts_what_it_skips(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "x.jsonl").write_text('{"kind":"manifest"}\n{"kind":"node","id":"a","label":"fact"}\n{"kind":"node","label":"fact"}\n{"kind":"node","id":"b","label":"Admin"}\n{"kind":"edge","src":"a","type":"ABOUT"}\n{"kind":"edge","src":"a","dst":"b","type":"DROP"}\nnot json\n{"kind":"x"}\n')
    got = {r["status"]: r["count"] for r in exchange.read(spark, str(path), ["fact"], ["ABOUT"]).groupBy("status").count().collect()}
    assert got == {"manifest": 1, "ok": 1, "no-id": 1, "label-refused": 1, "no-end": 1, "relation-refused": 1, "malformed": 1, "unknown-kind": 1}
    (path / "side.json").write_text('{"k1": {"content": "one"}, "k2": {"content": "two"}}')
    assert sorted((r["id"], r["content"]) for r in exchange.sidecar(spark, str(path / "side.json"), "struct<content:string>").collect()) == [("k1", "one"), ("k2", "two")]


def test_people_cascade(spark):
    p = people.registry(spark.createDataFrame([("p1", "Ann B. Lee", ["annie"]), ("p2", "Bo Lee", None), ("p3", " ", None), (None, "x", None)], "person string, name string, aliases array<string>"))
    m = spark.createDataFrame([(x,) for x in ("ann b lee!", "Ann Lee", "ANNIE", "Lee", "Bo", "nn", None, "??")], "mention string")
    assert {(r["mention"], r["person"], r["how"]) for r in people.resolve(m, p).collect()} == {("ann b lee!", "p1", "exact"), ("Ann Lee", "p1", "ends"), ("ANNIE", "p1", "exact"), ("Bo", "p2", "part"), ("nn", "p1", "part")}


def plain_pack(text, limit=3072):
    out, buf = [], ""
    for b in re.split(r"\n\s*\n", text):
        if buf and len(buf) + len(b) + 2 > limit:
            out.append(buf.strip())
            buf = b
        else:
            buf = f"{buf}\n\n{b}" if buf else b
    return out + [buf.strip()] * bool(buf.strip())


def test_pack_paragraphs_query(spark):
    docs = {r["doc_id"]: r["text"] for r in knowledge._markdown(spark, SF).collect() if r["text"]}
    want = {(d, i, len(c)) for d, t in docs.items() for i, c in enumerate(plain_pack(t))}
    assert {(r["id"], r["chunk"], r["chars"]) for r in knowledge.pack_paragraphs(spark, SF).collect()} == want


def test_legacy_ranker(spark):
    rows = [(1, f"e{i}", i, c, r) for i, (c, r) in enumerate([(0.9, 0.1), (0.5, 0.9), (0.45, 1.0), (0.85, 0.3), (0.2, 0.0)])]
    df = spark.createDataFrame(rows, "query_id long, id string, ord long, confidence double, legacy_relevance double")

    def compare(a, b):
        gap = b[3] - a[3]
        d = gap if abs(gap) > 0.1 else b[4] - a[4]
        return (d > 0) - (d < 0)

    want = [r[1] for r in sorted(rows, key=functools.cmp_to_key(compare))]
    assert [r["id"] for r in evaluation.legacy_order(df).orderBy("place").collect()] == want
