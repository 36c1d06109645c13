"""Every knowledge query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from lorehouse.plans import curation, curation_oracles, importing, importing_oracles, knowledge, oracles, retrieval, retrieval_oracles, storing, storing_oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


QUERIES = knowledge.QUERIES | curation.QUERIES | storing.QUERIES | retrieval.QUERIES | importing.QUERIES
SQL = oracles.ORACLE_SQL | curation_oracles.ORACLE_SQL | storing_oracles.ORACLE_SQL | retrieval_oracles.ORACLE_SQL | importing_oracles.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in result.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_without_sql():
    """These have tests of their own in test_plain_python, test_store, test_similarity and test_unified."""
    assert set(QUERIES) - set(SQL) == {"store_batches", "vector_index_search", "unified_hybrid", "unified_lexical", "unified_counts", "gate_batch", "legacy_ranker", "pack_paragraphs", "distinct_pairs_greedy"}
