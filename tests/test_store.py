"""The store, batch by batch, against plain Python that takes one request after the other."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from lorehouse.operators import store
from lorehouse.plans import knowledge, storing

SF = "/root/testdata/sf0.001"
REFUSE, CONFIRM = 0.97, 0.9
DAY = datetime.datetime(2025, 1, 1)


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def plain_store(entries, requests):
    """id to entry after all requests, and the decisions: status, entry_id, against, kind."""
    there, out = {e["id"]: dict(e) for e in entries}, {}
    key = lambda e: (e["user_id"], e["content"], e["content_type"], e["subject"])
    needs = {"supersede": ("target_id", "reason"), "update": ("target_id", "reason"), "complement": ("target_id",), "force-new": ("reason",)}
    for r in sorted(requests, key=lambda r: r["ord"]):
        act = r["action"]
        if act is not None and (act not in needs or any(not r[c] for c in needs[act])):
            out[r["id"]] = ("invalid_action", None, None, None)
            continue
        old = there.get(r["target_id"]) if act in ("supersede", "update") else None
        if act in ("supersede", "update") and old is None:
            out[r["id"]] = ("failed", None, None, None)
            continue
        if act == "update":
            for c in ("content", "subject", "confidence"):
                if r[c] is not None:
                    old[c] = r[c]
            old |= {"vec": r["vec"], "metadata": old["metadata"] | (r["metadata"] or {}), "history": [*old["history"], r["reason"]]}
            out[r["id"]] = ("updated", r["target_id"], None, None)
            continue
        if act is None and not r["skip_dedup"]:
            live = [e for e in there.values() if e["flag"] is None]
            copies = [e for e in live if key(e) == key(r)]
            near = [(cosine(r["vec"], e["vec"]), e["id"]) for e in live if r["vec"] and e["vec"] and e["content_type"] == r["content_type"]]
            top = max(near, key=lambda x: x[0], default=(0, None))
            if copies or top[0] >= CONFIRM:
                out[r["id"]] = ("dedup_required", None, copies[0]["id"] if copies else top[1], "exact" if copies else "refuse" if top[0] >= REFUSE else "confirm")
                continue
        meta = dict(r["metadata"] or {})
        if act == "supersede":
            meta |= {"supersedes": r["target_id"], "supersede_reason": r["reason"]}
            old |= {"flag": "SUPERSEDED", "superseded_by": r["id"]}
        if act == "force-new":
            meta["force_new_reason"] = r["reason"]
        there[r["id"]] = {c: r[c] for c in ("id", "content", "content_type", "user_id", "subject", "vec")} | {"confidence": r["confidence"] or 0.5, "metadata": meta, "history": [], "flag": None, "superseded_by": None, "related_to": [r["target_id"]] if act == "complement" else []}
        out[r["id"]] = ("superseded" if act == "supersede" else "stored", r["id"], None, None)
    return there, out


def example(seed, n=120, start=25):
    rng = random.Random(seed)
    word = lambda: f"note {rng.randrange(45)}"
    vec = lambda: None if rng.random() < 0.15 else [rng.gauss(0, 1) for _ in range(3)]
    common = lambda i: {"ord": i, "content": word(), "content_type": rng.choice(("fact", "memory")), "source": "personal", "user_id": "u", "subject": rng.choice((None, "s")), "vec": vec()}
    entries = [{"id": f"e{i}", **common(i), "confidence": 0.5, "metadata": {"k": "0", "only": f"{i}"}, "history": [], "related_to": [], "flag": "DELETED" if i % 9 == 4 else None, "superseded_by": None} for i in range(start)]
    requests = []
    for i in range(start, start + n):
        act = rng.choice((None,) * 6 + ("supersede", "update", "update", "complement", "force-new", "merge"))
        target = f"e{rng.randrange(start + 3)}" if act and rng.random() < 0.9 else None
        r = {"id": f"r{i}", **common(i), "ts": DAY + datetime.timedelta(days=i), "confidence": rng.choice((None, 0.25)), "metadata": rng.choice((None, {"k": f"{i}"}, {f"k{i % 3}": f"{i}", "k": "x"})), "action": act, "target_id": target, "reason": rng.choice(("why", "why", " ")) if act else None, "skip_dedup": act is None and rng.random() < 0.1}
        r["reason"] = r["reason"] and r["reason"].strip() or None
        requests.append(r)
    return entries, requests


def frame(spark, rows, ddl):
    names = [f.name for f in store._schema(ddl).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def opened(spark, folder, entries, **options):
    s = store.Store(spark, f"file://{folder}", refuse=REFUSE, confirm=CONFIRM, **options)
    s.load(spark.createDataFrame([tuple(e[c] for c in ("id", "ord", "content", "content_type", "source", "user_id", "subject", "vec", "confidence", "metadata", "flag")) for e in entries], "id string, ord long, content string, content_type string, source string, user_id string, subject string, vec array<double>, confidence double, metadata map<string,string>, flag string"))
    return s


def found(s):
    rows = s.entries().collect()
    there = {r["id"]: {c: r[c] for c in ("id", "content", "content_type", "user_id", "subject", "vec", "confidence", "metadata", "flag", "superseded_by")} | {"history": [h["reason"] for h in r["update_history"]], "related_to": r["related_to"]} for r in rows}
    assert len(there) == len(rows)
    return there, {r["id"]: (r["status"], r["entry_id"], r["against"], r["kind"]) for r in s.decisions().collect()}


def wanted(entries, requests):
    there, out = plain_store(entries, requests)
    for e in there.values():
        for c in ("ord", "source"):
            e.pop(c, None)
    return there, out


@pytest.mark.parametrize("seed", range(2))
def test_store_in_one_batch_and_in_several(spark, tmp_path, seed):
    entries, requests = example(seed)
    want = wanted(entries, requests)
    assert {x[0] for x in want[1].values()} == {"stored", "dedup_required", "invalid_action", "superseded", "updated", "failed"}
    for parts in (1, 4):
        s = opened(spark, tmp_path / f"{parts}", entries)
        size = -(-len(requests) // parts)
        for n in range(parts):
            s.apply(frame(spark, requests[n * size : (n + 1) * size], store.REQUEST), n + 1)
        got = found(s)
        assert got[1] == want[1]
        assert got[0] == want[0]
        prints = s.entries().select("fingerprint", store._fingerprint().alias("now")).collect()
        assert all(r["fingerprint"] == r["now"] for r in prints)
        if parts == 4:  # again, out of order, after a break half-way, and from a snapshot
            s.apply(frame(spark, requests[size : 2 * size], store.REQUEST), 2)
            assert found(s) == got
            s._write(spark.createDataFrame([], store.DECISION), "decisions/batch=4")
            s.apply(frame(spark, requests[3 * size :], store.REQUEST), 4)
            assert found(s) == got
            s.compact(2)
            s._write(s.entries().limit(0).select(store._names(store.ENTRY)), "versions/batch=1")  # nobody reads it any more
            assert found(s)[0] == got[0]


def test_store_follows_a_stream(spark, tmp_path):
    entries, requests = example(5, 40, 10)
    for n in range(2):
        frame(spark, requests[n * 20 : n * 20 + 20], store.REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = wanted(entries, requests)
    s = opened(spark, tmp_path / "store", entries)
    stream = lambda: spark.readStream.schema(store.REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        s.follow(stream(), f"{tmp_path}/state").awaitTermination()
        got = found(s)
        assert set(got[1]) == set(want[1]) and s._numbers("decisions") == [1, 2]


def test_superseding_needs_its_stores(spark, tmp_path):
    entries, _ = example(1, 0, 6)
    entries[0] |= {"content_type": "procedure"}
    request = {"ord": 50, "ts": DAY, "content": "new text", "content_type": "fact", "source": "personal", "user_id": "u", "action": "supersede", "reason": "why"}
    s = opened(spark, tmp_path, entries, down=("mongodb",))
    s.apply(frame(spark, [{**request, "id": "a", "target_id": "e0"}, {**request, "id": "b", "ord": 51, "target_id": "e1"}], store.REQUEST), 1)
    got = {r["id"]: (r["status"], r["error"]) for r in s.decisions().collect()}
    assert got == {"a": ("failed", "not flagged in mongodb"), "b": ("superseded", None)}
    there = {r["id"]: r for r in s.entries().collect()}
    assert "a" not in there and there["e0"]["flag"] is None and there["e1"]["superseded_by"] == "b"
    links = store.links(s.entries(), s.decisions()).collect()
    assert [tuple(r) for r in links] == [("b", "e1", "SUPERSEDES")]


def test_store_infers_what_is_left_open(spark):
    row = frame(spark, [{"id": "a", "ord": 1, "content": "How to configure the server: first run the build, then deploy"}], store.REQUEST)
    r = store.prepared(row, {}).first()
    assert r["user_id"] == "personal" and r["content_type"] and r["source"] and 0.5 <= r["confidence"] <= 0.9 and "mongodb" in r["targets"]
    assert store.decide(store.Store(spark, "file:///nowhere").entries(), store.prepared(row.limit(0), {})).count() == 0


def test_store_decides_like_the_gate(spark):
    """The registered query: the same decisions in ten batches as the gate takes in one."""
    want = {r["id"]: (r["decision"], r["against"]) for r in knowledge.gate_batch(spark, SF).collect()}
    got = {r["id"]: ({"stored": "pass"}.get(r["status"], r["kind"]), r["against"]) for r in storing.store_batches(spark, SF).collect()}
    assert got == want


def test_vectors_are_checked_as_they_are_stored(spark):
    rows = [{"id": f"a{i}", "ord": i, "content": f"text {i}", "vec": v} for i, v in enumerate(([1.0, 2.0], [1.0], [1.0, float("nan")], [float("inf"), 1.0], None))]
    got = {r["id"]: r["vec"] for r in store.prepared(frame(spark, rows, store.REQUEST), {}, 2).collect()}
    assert got == {"a0": [1.0, 2.0], "a1": None, "a2": None, "a3": None, "a4": None}
