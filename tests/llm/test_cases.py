"""Cases of the review for the training-data operators: no Spark where plain functions hold the rule."""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorehouse.llm import common, html, langid, licences, media, neardup, pieces, pii, queries, topk

SF = "/root/testdata/sf0.001"

# Main text


def test_main_text_without_end_tags():
    body = "<article><h1>Head</h1><p>One {} two.</p><p>The end.</p></article>"
    for top in ("<html><head><title>T</title><body>", "<html><head><title>T</title><style>p{}</style>", "<HEAD><meta charset=utf-8><script>x</script></HEAD><body>"):
        assert html.main_text(top + body.format("and")) == "Head\nOne and two.\nThe end."
    assert html.main_text(body.format("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>")) == "Head\nOne x=1 two.\nThe end."
    assert html.main_text(body.format("<object data='a.svg'>a picture</object>")) == "Head\nOne a picture two.\nThe end."
    for name in ("svg", "noscript", "button", "select", "iframe", "template"):
        assert html.main_text(body.format(f"<{name}>and")) == "Head\nOne and two.\nThe end."
        assert html.main_text(body.format(f"<{name}>gone</{name}>and")) == "Head\nOne and two.\nThe end."
    assert html.main_text(body.format("<script>var a = 1")) == "Head\nOne"


STORY = "".join(f"<p>Paragraph {i} of the story, which is long enough to be told from a teaser by its length alone.</p>" for i in range(6))
TOLD = [x.partition("</p>")[0] for x in STORY.split("<p>")[1:]]
SIDE = '<aside><p>a</p><p>b</p><p>c</p><p>d</p></aside>'


def test_main_text_weighs_runs_on_every_page():
    teasers = "<article><h2>Teaser</h2><p>Read more of this.</p></article>" * 2
    assert html.main_text(f"<body><div>{STORY}</div>{teasers}</body>").split("\n") == TOLD
    # A long story outside beats articles whose text surges too, and an article beats less text outside.
    assert html.main_text(f"<body><div>{STORY}</div><article>{STORY[:110]}</p></article></body>").split("\n") == TOLD
    assert html.main_text(f"<body><div>{STORY[:110]}</p></div><article>{STORY}</article></body>").split("\n") == TOLD
    assert html.main_text(f"<body><article class='related'>{STORY * 3}</article><div>{STORY}</div></body>").split("\n") == TOLD


def test_main_text_keeps_light_runs_of_the_container():
    for tag in ("div", "article", "main", "section"):
        page = f"<body><div>Log in</div>{SIDE}<{tag}>{STORY}{SIDE}<p>The end.</p></{tag}>{SIDE}<div>Home</div></body>"
        assert html.main_text(page).split("\n") == [*TOLD, "The end."], tag
    assert html.main_text("<body><article><p>Brief.</p></article></body>") == "Brief."


def test_main_text_without_marks():
    """Neither article tags nor telling class names: the distribution alone finds the story."""
    menu = "<div><div><a href=x>Home</a> <a href=y>News</a></div><ul><li><a href=z>Sport</a></li></ul></div><div>Log in</div>"
    after = "<div><ul><li><a href=1>One more thing to read that has a very long title, longer than most, indeed</a></li></ul></div><div>About us</div>"
    for page in (f"<body>{menu}<div><h1>Title</h1>{STORY}<p>The end.</p></div>{after}</body>", f"<body>{menu}<div><div><h1>Title</h1></div><div>{STORY}</div><div>The end.</div></div>{after}</body>"):
        assert html.main_text(page).split("\n") == ["Title", *TOLD, "The end."]


def test_main_text_inline_elements():
    for tag in ("div", "article"):
        page = f"<{tag}>{STORY}<p>Hello <span class='promo'><span>Buy</span> NOW CHEAP</span> world.</p><p>A<span class='ad'><b>q</b><i>one</i> LEAK</span> <b>b</b>c</p></{tag}>"
        assert html.main_text(page).split("\n") == [*TOLD, "Hello world.", "A bc"]
    assert html.main_text(f"<article>{STORY}<p>See <a href=x>the report</a>.</p><p><a href=y>All of it</a></p></article>").split("\n") == [*TOLD, "See the report.", "All of it"]


def test_main_text_of_very_long_pages():
    began = time.time()
    html.main_text("<div>" * 50000 + "x" + "</span>" * 50000)
    html.main_text("<div>" * 50000 + "<p>hello there" * 50000 + "</div>" * 50000)
    assert time.time() - began < 30


def test_main_text_of_real_pages_without_article(spark):
    """The same text with article as div: the tag decides nothing on these pages."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()
    for r in rows:
        assert html.main_text(r["html"]) == html.main_text(re.sub("(</?)article", r"\1div", r["html"])) != ""


# Licenses


def found_licenses(text):
    return {x[1] for x in licences.matches(*common.text_buffer(pa.array([text], pa.string())), licences.prepare(licences.TEMPLATES))}


def test_licenses_by_their_own_names():
    for name, texts in licences.TEMPLATES.items():
        for text in texts:
            if text != licences._BSD_HEAD:
                assert found_licenses(f"Some words before. {text} And some words after it.") == {name}, text
    conditions = " Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce it."
    assert found_licenses(licences._BSD_HEAD + conditions + " This software is provided as is.") == {"BSD-2-Clause"}
    assert found_licenses(licences._BSD_HEAD + conditions + " " + licences.TEMPLATES["BSD-3-Clause"][1]) == {"BSD-3-Clause"}
    notice = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for kind, version, name in (("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Affero ", "3", "AGPL-3.0"), ("Lesser ", "3", "LGPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1")):
        assert found_licenses(notice.format(kind, version)) == {name}


def test_licenses_give_a_match_a_copy():
    prepared, mit = licences.prepare(licences.TEMPLATES), licences.TEMPLATES["MIT"][2]
    for n in (1, 2, 3, 10):
        found = licences.matches(*common.text_buffer(pa.array([" ".join([mit] * n)], pa.string())), prepared)
        assert [x[2:4] for x in found] == [(i * (len(mit) + 1), i * (len(mit) + 1) + len(mit) - 1) for i in range(n)]


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_licenses_against_containment_by_brute_force():
    """Texts with damaged copies: a license of one template is found exactly if some window holds 0.75 of its shingles."""
    rng, name = np.random.default_rng(3), "X"
    template = " ".join(f"t{i}" for i in range(60))
    prepared, rules = licences.prepare({name: [template]}), {tuple(f"t{j}" for j in range(i, i + 5)) for i in range(56)}
    for _ in range(150):
        words = template.split()
        for i in rng.choice(60, rng.integers(0, 5), replace=False):
            words[i] = "damaged"
        text = " ".join([*(f"a{i}" for i in range(rng.integers(0, 90))), *words, *(f"z{i}" for i in range(rng.integers(0, 90)))])
        w = plain_words(text)
        best = max(len({tuple(w[i : i + 5]) for i in range(a, min(a + 70, len(w) - 4))} & rules) for a in range(len(w)))
        found = licences.matches(*common.text_buffer(pa.array([text], pa.string())), prepared)
        assert bool(found) == (best >= 0.75 * 56), (best, text)
        assert not found or found[0][4] == best / 56


# Media


def test_images_of_every_form():
    grey, rgb = np.arange(35, dtype=np.uint8).reshape(5, 7), np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    bits = (grey % 3 == 0).astype(np.uint8)
    text = lambda a: " ".join(map(str, a.ravel().tolist())).encode()
    assert (media.decode(b"P2 # c\n7 5\n255\n" + text(grey)) == grey).all() and (media.decode(b"P3\n5 4 255\n" + text(rgb)) == rgb).all()
    assert (media.decode(b"P6\n5 4\n255\n" + rgb.tobytes()) == rgb).all() and (media.decode(b"P1\n7 5\n" + text(bits)) == 255 * (1 - bits)).all()
    assert (media.decode(b"P4\n7 5\n" + np.packbits(bits, axis=1).tobytes()) == 255 * (1 - bits)).all()
    wide = grey.astype(np.uint16) * 1000
    assert (media.decode(b"P5\n7 5\n65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    pad = lambda a: b"".join(r.tobytes() + bytes(-len(r.tobytes()) % 4) for r in a[::-1])
    head = lambda bpp, w, h, start, used=0: struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, start, 40, w, h, 1, bpp, 0, 0, 0, 0, used, 0)
    assert (media.decode(head(24, 5, 4, 54) + pad(rgb[:, :, ::-1].reshape(4, -1))) == rgb).all()
    palette = np.array([[0, 0, 0, 0], [255, 255, 255, 0]], np.uint8).tobytes()
    assert (media.decode(head(1, 7, 5, 62, 2) + palette + pad(np.packbits(bits, axis=1))) == 255 * bits).all()


def test_bad_images_give_nulls():
    for raw in (b"P2 2 1 255 300 1", b"P2 2 1 255 -5 1", b"P2 1 1 255 " + b"9" * 23, b"P1 2 1 07", b"P5 99999 99999 255\n", b"P5 999999999 999999999 255\n", b"P6 1 1 255\nab", b"BM" + b"\xff" * 60, b"BM", b"P9", b"", None):
        assert media.media_columns(raw) == (None, None, None), raw


def test_media_against_plain_python(spark):
    """The query's columns from the definition: payload, NPY of the samples, the tile's and the hash's means by loops."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_media(spark, SF).where("doc_id % 20 = 0").collect():
        raw = (docs[r["doc_id"]] or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        image = np.frombuffer(full, np.uint8).reshape(-1, 64)

        def mean(y, x, h, w, image=image):
            ys, xs = (np.clip(np.minimum(np.arange(n) + 1, (i + 1) * n / k) - np.maximum(np.arange(n), i * n / k), 0, None) for n, i, k in ((image.shape[0], y, h), (64, x, w)))
            return (image * ys[:, None] * xs).sum() / (ys.sum() * xs.sum())

        npy = media.to_npy(image)
        assert (r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), hashlib.sha256(npy).hexdigest())
        small = np.array([[mean(y, x, 8, 9) for x in range(9)] for y in range(8)]).round(6)
        assert r["feature"] == np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()
        tile = np.rint([[mean(y, x, 32, 32) for x in range(32)] for y in range(32)])
        got = media.from_npy(media.media_columns(media.text_image(full))[1])
        assert np.abs(got - tile).max() <= 1 and r["tile_sha256"] == hashlib.sha256(media.to_npy(got)).hexdigest()


# Pieces


def test_pieces_are_sampled_in_proportion():
    """Shares of a word's segmentations against the enumerated lattice."""
    p = pieces.load()
    word, n = " nation", 20000
    ways: dict[tuple, float] = {}
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = tuple(word[a:b] for a, b in itertools.pairwise(edges))
        if all(x in p.ids for x in parts):
            ways[tuple(p.ids[x] for x in parts)] = float(np.prod([p.weight[x] for x in parts]))
    total = sum(ways.values())
    ids, rows = pieces.encode_rows(pieces.Lattice(p), [word] * n, [pieces.row_key(i, 0) for i in range(n)])
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(rows.tolist()))
    assert set(seen) <= set(ways)
    for way, weight in ways.items():
        share = weight / total
        assert abs(seen[way] / n - share) < 5 * (share / n) ** 0.5 + 1e-3


def test_pieces_of_long_runs():
    p, rng = pieces.load(), np.random.default_rng(1)
    lattice = pieces.Lattice(p)
    texts = ["".join(rng.choice(list("etaoinß漢"), n)) for n in (1, 63, 64, 65, 300, 20000)]
    began = time.time()
    ids, rows = pieces.encode_rows(lattice, texts, list(range(len(texts))))
    assert [b"".join(p.raw[i] for i in ids[a:b]).decode() for a, b in itertools.pairwise(rows.tolist())] == texts and time.time() - began < 20
    alone = [pieces.encode_rows(pieces.Lattice(p), [t], [i])[0].tolist() for i, t in enumerate(texts)]
    assert alone == [ids[a:b].tolist() for a, b in itertools.pairwise(rows.tolist())]  # the vectors and the loop agree


# Personal data

MISSES = [  # (text before, candidate, text after, kind or None)
    *[(w, f"{u} [at] mail{i}.example.com", " soon", "email") for i, (w, u) in enumerate([("write to ", "ann.lee"), ("contact ", "bo"), ("mail ", "c.d"), ("e-mail ", "ed")] * 5)],
    *[("call ", f"(0{20 + i}) 555-{7000 + i}".replace("(0", "(4"), " today", "phone") for i in range(20)],
    *[("token = ", hashlib.sha1(str(i).encode()).hexdigest(), " ends", "secret") for i in range(20)],
    *[("commit ", hashlib.md5(str(i).encode()).hexdigest()[:24], " fixes it", None) for i in range(20)],
    *[("version ", f"{i + 300}.{i}.{i + 2}.{i + 900}", " is out", None) for i in range(20)],
    *[("order ", f"99{i:02}{'0123456789'[i % 10] * 2}1234567{i % 7}12", " was sent", None) for i in range(40)],
]


def test_pii_classifier_adds_spans(spark):
    """Precision and recall of what the classifier adds to the base spans, on rows with planted spans and near misses."""
    base = [f"Mail a{i}.b@mail{i % 9}.example.com or call +1 ({200 + i}) 555-{7000 + i} from 10.{i}.3.{i % 250} now" for i in range(60)]
    texts = base + [f"Some words here, {a}{c}{z} and so on" for a, c, z, _ in MISSES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["pii"] if not s["base"]] for r in pii.find(docs, pii.train(docs)).collect()}
    want = {len(base) + i: (k, c) for i, (_, c, _, k) in enumerate(MISSES) if k and not pii.base_spans(texts[len(base) + i])}
    added = [(d, x) for d, xs in found.items() for x in xs]
    right = sum(want.get(d) == x for d, x in added)
    assert right / len(added) >= 0.95 and right / len(want) >= 0.9, (right, len(added), len(want))


def test_reliabilities_against_plain_em():
    counts = {"111?1": 60, "101?1": 20, "0001?": 5, "?00?1": 30, "?0001": 25, "11110": 3}
    prior, held = 0.5, {(z, i, v): ((0.6, 0.1, 0.3) if z else (0.1, 0.6, 0.3))["10?".index(v)] for z in (0, 1) for i in range(5) for v in "10?"}
    for _ in range(100):
        true = {}
        for p in counts:
            like = [prior if z else 1 - prior for z in (0, 1)]
            for z in (0, 1):
                for i, v in enumerate(p):
                    like[z] *= held[z, i, v]
            true[p] = like[1] / (like[0] + like[1])
        prior = (sum(counts[p] * true[p] for p in counts) + 1) / (sum(counts.values()) + 2)
        for z, i in itertools.product((0, 1), range(5)):
            own = {v: sum(n * (true[p] if z else 1 - true[p]) for p, n in counts.items() if p[i] == v) + {"1": 6 if z else 1, "0": 1 if z else 6, "?": 3}[v] for v in "10?"}
            for v in "10?":
                held[z, i, v] = own[v] / sum(own.values())
    got = pii.reliabilities(counts)
    assert got[0] == pytest.approx(prior, abs=1e-9) and got[2] == pytest.approx(true, abs=1e-9)


def test_pii_query_columns(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_personal_data(spark, SF).collect():
        base = sorted(pii.base_spans(docs[r["doc_id"]]))
        named = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x.startswith(k) for x in named) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest() and set(named) <= set(r["spans"].split(",")) | {""}


# Language


def test_language_against_plain_profiles(spark):
    """Rank-order profiles with dictionaries: the same guess and score."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect() if r["text"]][:80]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langid.train(df)).collect()}

    def bag(text):
        return Counter(langid.grams([text])[0].tolist())

    sums: dict[str, Counter] = {}
    for _, t, x in docs:
        if x is not None:
            sums.setdefault(x, Counter()).update(bag(t))
    ranks = {x: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda y: (-y[1], y[0]))[: langid.PROFILE])} for x, c in sums.items()}
    vocab = set().union(*ranks.values())
    for d, t, _ in docs:
        top = sorted(((g, n) for g, n in bag(t).items() if g in vocab), key=lambda y: (-y[1], y[0]))[: langid.TOP]
        dist = {x: sum(min(abs(r[g] - i), langid.PROFILE) if g in r else langid.PROFILE for i, (g, _) in enumerate(top)) for x, r in ranks.items()}
        best = min(sorted(dist), key=dist.get)
        assert got[d] == (best, pytest.approx(1 - dist[best] / (langid.PROFILE * len(top)))), d


def test_grams_are_of_letters_and_word_ends():
    bucket = {}
    for n in (1, 2, 3):
        for w in ("ab", "a", "b"):
            bucket[w] = sorted(langid.grams([w])[0].tolist())
    assert len(bucket["ab"]) == 2 + 3 + 2 and len(bucket["a"]) == 1 + 2  # a b, _a ab b_, _ab ab_; a, _a a_
    assert sorted(langid.grams(["a, b!"])[0].tolist()) == sorted(bucket["a"] + bucket["b"])
    assert langid.grams(["12 !"])[0].tolist() == []


# Top-k


def test_top_k_with_ties_and_repeated_ids(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (5, [2, 0]), (3, [2, 0]), (3, [2, 0]), (4, [0, 9]), (100, [3, 3]), (None, [9, 9]), (7, None), (8, [1, 1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("score", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 4).collect())
    want = []
    kept = [(i, x, v) for i, (x, v) in enumerate(rows) if x is not None and v is not None]
    for i, q, v in kept:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), x) for j, x, w in kept if j != i and len(w) == len(v))[:4]
            want += [(q, n, x, -s) for n, (s, x) in enumerate(best, 1)]
    assert got == sorted(want)


# Pipeline


def test_stages_on_awkward_tables(spark):
    pipeline = __spark_entry__.corpus_pipeline
    text = "the house by the river was old and nobody had lived in it for years"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, "another text that has nothing to do with it at all", "en", "a"), (None, text + " again", "en", None), (None, "only rows without an id have this one text here", None, "b"), (None, "only rows without an id have this one text here", None, "b"), (2, None, "en", "b"), (3, "", None, None), (4, "Mail x.y@z.com, or +1 (415) 555-2671, please", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    one = [(r["doc_id"], r["text"]) for r in neardup.one_of_each(df).collect()]
    assert sorted(map(str, one)) == sorted(map(str, [(1, text), (1, rows[2][1]), (None, rows[4][1]), (2, None), (3, ""), (4, rows[8][1])]))
    held = Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    unlabelled = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    for docs in (df, unlabelled):
        rows = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
        known = Counter((r["doc_id"], r["text"], r["source"]) for r in pipeline.language(spark, docs, SF).collect())
        assert all(n == rows[x] and x[1] and any(c.isalpha() for c in x[1]) for x, n in known.items())  # rows alike stay or go alike
        assert not known if docs is unlabelled else (1, text, "a") in known
        clean = pipeline.personal_data(spark, docs, SF).collect()
        assert Counter((r["doc_id"], r["source"]) for r in clean) == Counter((i, s) for i, _, s in rows.elements())
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)
        taken = Counter((r["doc_id"], r["text"], r["source"]) for r in pipeline.mix(spark, docs, SF).collect())
        times = {x: taken[x] / rows[x] for x in rows}
        assert set(taken) <= set(rows) and all(t in (0, 1, 2) for t in times.values())
        for x in times:  # of one id and source all are taken alike
            assert {times[y] for y in times if (y[0], y[2]) == (x[0], x[2])} == {times[x]}
        words = {s: sum(len((t or "").split()) * n for (_, t, z), n in rows.items() if z == s) for s in {x[2] for x in rows}}
        assert all(not any(times[x] for x in times if x[2] == s) for s, w in words.items() if not w)  # a source without words is not taken
        out = pipeline.encode(spark, docs, SF).collect()
        assert len(out) == sum(rows.values()) and all(r["lossless"] and r["n_pieces"] == len(r["piece_ids"]) for r in out)
        alike = {}
        for r in out:
            if r["doc_id"] in (2, 3, 4):
                alike[r["doc_id"]] = r["piece_ids"]
        assert alike[2] == alike[3] == [] and len(alike[4]) > 5
    assert sum(held.values()) == 9
    for name, stage in pipeline.STAGES:
        out = stage(spark, df.limit(0), SF)
        assert out.collect() == [] and (name == "encode" or out.columns == df.columns)
    assert pipeline.personal_data(spark, df, SF).where("doc_id = 4").first()["text"] == "Mail [email], or [phone], please"


def test_main_text_names_of_parts():
    for name in ("article-comments", "entry-comments", "postComments", "body-cookie-notice", "post-share-widget", "story-ad", "related-post", "comment-list", "ad slot", "post comments", "sponsored-content"):
        for tag in ("div", "article"):
            page = f"<{tag}>{STORY}<div class='{name}'><p>This is not of the story, though it is a sentence long enough to be weighed.</p></div></{tag}>"
            assert html.main_text(page).split("\n") == TOLD, name
    for name in ("post-header", "entry-content", "story-body", "content has-sidebar", "no-comments article", "main-story"):
        page = f"<div><div class='{name}'><h1>Head</h1>{STORY}</div></div>"
        assert html.main_text(page).split("\n") == ["Head", *TOLD], name
    page = f"<article>{STORY}<p>As <a class='related-link' href=x>told here</a>, the <b class=notice>first</b> one.</p></article>"
    assert html.main_text(page).split("\n") == [*TOLD, "As told here, the first one."]


def test_main_text_of_deep_containers():
    side = "<div><a href=x>Log in</a></div>"
    for deep in (1, 63, 64, 65, 300, 5000):
        page = f"<body>{side}{'<div>' * deep}<h1>Title</h1>{STORY}<p>The end.</p>{'</div>' * deep}<div>About us</div></body>"
        assert html.main_text(page).split("\n") == ["Title", *TOLD, "The end."], deep


def test_licenses_far_from_their_clauses():
    head, third = licences._BSD_HEAD, licences.TEMPLATES["BSD-3-Clause"][1]
    for between in (0, 150, 190, 230, 5000):
        assert found_licenses(f"{head} {'word ' * between}{third}") == {"BSD-3-Clause"}, between
    # the clause of a later copy isn't the first one's
    two = licences.matches(*common.text_buffer(pa.array([f"{head} {'word ' * 40} {head} {third}"], pa.string())), licences.prepare(licences.TEMPLATES))
    assert [x[1] for x in two][:2] == ["BSD-2-Clause", "BSD-3-Clause"]


def test_licenses_of_a_long_text_of_copies_in_linear_time():
    mit, took, prepared = licences.TEMPLATES["MIT"][2], [], licences.prepare(licences.TEMPLATES)
    for n in (3000, 12000):
        text = common.text_buffer(pa.array(["\n\n".join(f"Copyright (c) {i} Someone\n{mit}" for i in range(n))], pa.string()))
        began = time.time()
        assert len([x for x in licences.matches(*text, prepared) if x[1] == "MIT"]) == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1 and took[1] < 30
