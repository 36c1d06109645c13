"""The training-data operators against plain Python on small tables, with the awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorehouse.llm import common, html, langid, licences, media, mixing, neardup, oracles, pieces, pii, queries, sharding, topk

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "Ünï 漢字 😀   text"), (6, "Ünï 漢字 😀   text"), (None, "one two three four five six"), (7, LONG), (8, "a\r\nb\x00c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, null and repeated ids, and columns whose names clash with results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") > 3, "a"), "n_chars": F.lit(0).cast("long"), "size": F.lit("x"), "score": F.lit("y"), "kind": F.lit(1)})


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def chains():
    """Groups of near copies of rising distance, and texts that share one long passage."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 12), replace=False):
            w[j] = f"e{rng.integers(0, 40)}"
        out.append((1000 + i, " ".join(w)))
    out += [(2000 + i, " ".join([f"p{i}_{j}" for j in range(60)] + base[:70])) for i in range(40)]
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = texts(spark) + chains() + [r for r in ODD if r[0] != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute_classes(rows), key=key)


def test_near_duplicates_awkward_rows(spark, odd):
    assert neardup.near_duplicates(odd).count() == len(ODD)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()] + [(7001, None), (7002, [float("nan")] * 64), (7003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect())
    vecs = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v is not None and np.isfinite(v).all() and len(v) == 64}
    want = []
    for q in vecs:
        if q % 10 == 0:
            best = sorted((-int(vecs[q] @ vecs[x]), x) for x in vecs if x != q)[:10]
            want += [(q, i, x, -s) for i, (s, x) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for s, group in by.items():
        assert 0 <= s < n and sorted(r["slot"] for r in group) == list(range(len(group)))
    total, most = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
    assert all(abs(sum(r["size"] for r in by[s]) - total / n) <= most for s in range(n))


def test_shards(spark, odd):
    rows = queries.op3_shards(spark, SF).collect()
    texts_ = dict(texts(spark))
    assert len(rows) == len(texts_)
    check_shards(rows, 8)
    for r in rows:
        raw = (texts_[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    placed = sharding.assign_shards(odd, ["doc_id"], F.octet_length("text"), 3, ["doc_id", "text"])
    assert placed.count() == len(ODD)
    assert sharding.assign_shards(odd.limit(0), ["doc_id"], F.octet_length("text")).count() == 0


def test_media_round_trip(spark, odd):
    rows = media.text_media(odd).collect()
    want = []
    for d, t in ODD:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in rows)
    assert media.text_media(odd.limit(0)).count() == 0
    files = [(1, b"junk"), (2, None), (3, media.text_image(b"x" * 64))]
    got = {r["id"]: r for r in media.decode_media(spark.createDataFrame(files, "id long, media binary")).collect()}
    assert got[1]["npy"] is got[2]["npy"] is None and media.from_npy(got[3]["npy"]).tobytes() == b"x" * 64 and media.from_npy(got[3]["tile"]).shape == (32, 32)


def test_area_resize_and_images():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.area_resize(image, 3, 4), image.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert (media.decode(media.encode_bmp(image)) == image).all() and (media.decode(media.encode_pgm(image)) == image).all()


def test_pieces_lossless_and_repeatable(spark, odd):
    first = pieces.decode(pieces.encode(odd)).select("doc_id", "text", "piece_ids", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in first) and len(first) == len(ODD)
    again = pieces.encode(odd.repartition(5)).select("doc_id", "text", "piece_ids").collect()
    assert sorted(str((r["doc_id"], r["text"], r["piece_ids"])) for r in first) == sorted(str((r["doc_id"], r["text"], r["piece_ids"])) for r in again)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(5)
    assert pieces.encode(docs, seed=0).collect() != pieces.encode(docs, seed=1).collect()
    assert pieces.encode(odd.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="cookie-banner">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First   paragraph<br>goes on.</p><aside>Side</aside><ul><li>a</li><li>b</li></ul><p>x &lt; y</p></article>
<div id="comments"><p>Nice post, thank you very much for writing all of this down for us, great work.</p></div><footer>(c)</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Head & more\nFirst paragraph goes on.\na\nb\nx < y"
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<"), (5, "plain text")], "page_id long, html string").withColumn("main_text", F.lit(0))
    got = {r["page_id"]: r["main_text"] for r in html.extract(df).collect()}
    assert got[2] == got[3] == "" and got[5] == "plain text" and set(got) == {1, 2, 3, 4, 5}
    assert html.extract(df.limit(0)).count() == 0


def test_mix(spark, odd):
    rows = queries.op7_mix(spark, SF).collect()
    for target in {(r["source_size"], r["target"]) for r in rows}:
        mine = [r for r in rows if (r["source_size"], r["target"]) == target]
        assert abs(sum(r["taken"] for r in mine) - target[1]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    assert mixing.mix_documents(odd).count() == len(ODD)
    assert mixing.mix_documents(odd.limit(0)).count() == 0


def test_licenses(spark, odd):
    mit = licences.TEMPLATES["MIT"][1]
    near = mit.replace("obtaining", "getting").replace("copies", "duplicates")
    df = spark.createDataFrame([(1, "word " * 50 + mit + " tail" * 30), (2, near), (3, "nothing here at all of the kind")], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licences.scan(df).collect()}
    assert [x["license"] for x in got[1]] == ["MIT"] and [x["license"] for x in got[2]] == ["MIT"] and got[3] == []
    assert licences.scan(odd).count() == len(ODD)
    assert licences.scan(odd.limit(0)).count() == 0


def base_brute(t):
    out = []
    for k, p, ok in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (2, r"[0-9]([ -]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
        (3, r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        out += [(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return sorted(out)


def test_pii_base_spans(spark, odd):
    hard = ["a@b.c.d@e.f", "x@y", "@a.b", "1.2.3.4.5.6.7.8 999.1.1.1.1", "4111 1111 1111 1111-2", "+1 (415) 555-2671. +49.30 123456 4111111111111111", "é😀 a.b+c@d-e.fr, 10.0.0.1"]
    for t in [x for _, x in texts(spark) if x] + hard:
        assert sorted(pii.base_spans(t)) == base_brute(t), t
    w = pii.train(odd)
    assert pii.find(odd, w).count() == len(ODD)
    assert pii.find(odd.limit(0), pii.train(odd.limit(0))).count() == 0
    df = spark.createDataFrame([(1, "mail x.y@z.com now"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(df, w).collect()} == {1: "mail [email] now", 2: None}


def test_language_accuracy_and_awkward_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    got = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and truth is not null")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("int"))).first()[0] >= 0.95
    model = langid.train(spark.createDataFrame([("hello world there", "en"), ("guten tag welt", "de")], "text string, lang string"))
    rows = [r["lang_pred"] for r in langid.predict(odd, model).orderBy("doc_id", "text").collect()]
    assert len(rows) == len(ODD) and rows.count("und") == 3
    assert {r["lang_pred"] for r in langid.predict(odd, []).collect()} == {"und"}


def test_pipeline(spark):
    corpus_pipeline = __spark_entry__.corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.cut(stage(spark, kept, SF))
        assert kept.columns == docs.columns, name
        if name == "near_duplicates":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in classes if d == c)
        if name == "personal_data":
            assert not any(base_brute(r["text"]) for r in kept.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert len(last) == kept.count() and all(r["lossless"] for r in last)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = queries.QUERIES[name](spark, SF), con.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want
