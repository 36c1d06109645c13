"""A judge's answer is for a pair of entries, also where contents repeat or are missing; copies of a vector are told apart by their ids alone."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorehouse.functions import text as T
from lorehouse.operators import gate, similarity
from lorehouse.plans import curation, curation_oracles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["'same'", "CASE WHEN doc_id % 5 = 1 THEN text END"])
def test_decisions_match_sql(spark, tmp_path, text):
    """Before, pairs of the same contents had any one's answer, and pairs with a null content none."""
    con = duckdb.connect()
    for t in ("labels", "embeddings", "benchmark", "conversations"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"COPY (SELECT doc_id, {text} AS text, lang, source, n_chars FROM '{SF}/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT id, candidate, band, relation FROM ({curation_oracles.ORACLE_SQL['judge_decisions']})").fetchall()
    got = [tuple(r) for r in curation.QUERIES["judge_decisions"](spark, str(tmp_path)).select("id", "candidate", "band", "relation").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) != []


def test_answers_by_contents_or_by_pair(spark):
    pairs = spark.createDataFrame([(i, "x", "y" if i < 3 else "z", "refuse" if i == 2 else "confirm") for i in range(4)], "id int, new_content string, candidate_content string, band string")
    key = T.pair_key(F.col("new_content"), F.col("candidate_content")).alias("key")
    known = lambda rows: {r["id"]: r["relation"] for r in rows.collect()}
    assert known(gate.judged(pairs, pairs.where("id = 0").select(key, F.lit("complement").alias("answer")))) == {0: "complement", 1: "complement", 2: "duplicate", 3: None}
    own = pairs.where("id < 2").select("id", key, F.when(F.col("id") == 0, "complement").otherwise("DUPLICATE").alias("answer"))
    assert known(gate.judged(pairs, own, ["id"])) == {0: "complement", 1: "duplicate", 2: "duplicate", 3: None}


def test_copies_tie(spark):
    """Eight copies of 300 vectors in blocks: a row is as near to all copies of another, in whatever block and place they are multiplied."""
    x = np.random.default_rng(5).normal(size=(300, 64)) + 0.3
    rows = [(f"r{(i * 7919) % 2400:04d}", i % 300, x[i % 300].tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "id string, copied int, vec array<double>").withColumn("content_type", F.lit("fact"))
    near = similarity.similar(df, df, ["content_type"], 0.1, block=512, carried=["copied"], top=20)
    sims = near.groupBy("copied_a", "copied_b").agg(F.count("*").alias("n"), F.countDistinct("sim").alias("sims")).collect()
    assert max(r["n"] for r in sims) > 8 and {r["sims"] for r in sims} == {1}
