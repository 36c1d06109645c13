"""Parquet tables, and the knowledge-store tables derived from them: entries, edges, shards, query strings, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT_TYPES = ("memory", "insight", "pattern", "relationship", "fact", "procedure")
SOURCES = ("personal", "technical", "cross_domain")
RELATIONS = ("RELATED_TO", "ABOUT", "SOLVES", "REQUIRES", "SUPERSEDES")
#: Projects by pattern, as inference takes them: what these documents are told apart by.
PROJECTS = {"licensing": "license|copyright", "accounts": "password|token"}
#: The moment for which ages are computed; nothing reads the clock.
AS_OF = "2025-03-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a 0-based index."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge entries, one a document: id, ord (arrival), content, content_type, source, user_id, confidence, ts, flag, flag_date, superseded_by, subject, tags."""
    d, quality = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("doc_id")
    flag = F.when(n % 17 == 0, "SUPERSEDED").when(n % 23 == 0, "DELETED").when(n % 29 == 0, "RETRACTED")
    successor = F.when(n % 34 == 0, None).when(n % 51 == 0, F.concat(F.lit("d"), n + 10000000)).otherwise(F.concat(F.lit("d"), n + 1))
    ts = F.timestamp_add("DAY", ((n * 7919) % 400).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return d.join(quality, "doc_id", "left").select(
        F.concat(F.lit("d"), n).alias("id"),
        n.alias("ord"),
        F.col("text").alias("content"),
        pick(CONTENT_TYPES, n % 6).alias("content_type"),
        pick(SOURCES, F.floor(n / 6) % 3).alias("source"),
        F.concat(F.lit("u"), n % 4).alias("user_id"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4).otherwise(0.65).alias("confidence"),
        ts.alias("ts"),
        flag.alias("flag"),
        F.when(flag.isNotNull(), F.timestamp_add("DAY", F.lit(30), ts)).alias("flag_date"),
        F.when(flag == "SUPERSEDED", successor).alias("superseded_by"),
        F.concat_ws(".", "lang", F.col("source")).alias("subject"),
        F.array("lang", F.col("source")).alias("tags"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed typed edges between entries: src, dst (some null), type, strength 0 to 100, ord; node d0 is a hub, and some edges repeat."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n, size = F.col("doc_id"), d.agg(F.count("*").alias("n"))
    base = d.join(F.broadcast(size)).select(  # size is one row
        F.concat(F.lit("d"), n).alias("src"),
        F.when(n % 97 != 0, F.concat(F.lit("d"), (n * 31 + 7) % F.col("n"))).alias("dst"),
        pick(RELATIONS, n % 5).alias("type"),
        ((n * 37) % 101).cast("int").alias("strength"),
        (n * 3).alias("ord"),
        n.alias("k"),
    )
    repeated = base.where("k % 11 = 0").withColumn("ord", F.col("ord") + 1)
    hub = base.where("k % 5 = 0").withColumn("dst", F.lit("d0")).withColumn("ord", F.col("ord") + 2)
    return base.unionByName(repeated).unionByName(hub).drop("k")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rows of entries, one a conversation turn: id, parent_id (itself for some, null for others), content, score."""
    c = table(spark, sf_dir, "conversations")
    size = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    own = F.concat_ws("_", F.lit("m"), "conv_id", "turn")
    parent = F.when(F.col("conv_id") % 19 == 0, None).when((F.col("turn") == 0) & (F.col("conv_id") % 13 == 0), own).otherwise(F.concat(F.lit("d"), F.col("conv_id") % F.col("n")))
    return c.join(F.broadcast(size)).select(own.alias("id"), parent.alias("parent_id"), F.col("text").alias("content"), (F.col("turn") % 10 / 10).alias("score"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query strings, one a benchmark item: query_id, query (its first five words of two letters or more, lower-cased, ASCII)."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z0-9_])[a-z]{2,}(?![a-z0-9_])"), F.lit(0)), 1, 5)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-free embeddings as doubles: id (of the entry), vec array<double>, label."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"), "label")
