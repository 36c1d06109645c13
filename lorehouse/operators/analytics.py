"""Counts, health and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def recent(entries: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(total, recent): entries, and those of the last hours before as_of."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.timestamp_add("HOUR", F.lit(-hours), F.lit(as_of).cast("timestamp"))).alias("recent"))


def density(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, relationships, density) of edges with both ends."""
    n = entries.agg(F.count("*").alias("nodes"))
    e = edges.where("src is not null and dst is not null").agg(F.count("*").alias("relationships"))
    return n.join(F.broadcast(e)).withColumn("density", F.when(F.col("nodes") > 0, F.col("relationships") / F.col("nodes")).otherwise(0.0))  # one row each


def cache_report(accesses: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates of accesses (level, hit): l1 and l2 rates, efficiency over all first-level lookups, estimated speed-up."""
    l1, l2 = F.col("level") == "l1", F.col("level") == "l2"
    g = accesses.groupBy(*by).agg(F.count_if(l1).alias("n1"), F.count_if(l1 & F.col("hit")).alias("h1"), F.count_if(l2).alias("n2"), F.count_if(l2 & F.col("hit")).alias("h2"))
    rate = lambda h, n: F.when(F.col(n) > 0, F.col(h) / F.col(n)).otherwise(0.0)
    g = g.withColumn("l1_rate", rate("h1", "n1")).withColumn("l2_rate", rate("h2", "n2"))
    g = g.withColumn("efficiency", F.when(F.col("n1") > 0, (F.col("h1") + F.col("h2")) / F.col("n1")).otherwise(0.0))
    return g.withColumn("speedup", F.col("l1_rate") * 100 + F.col("l2_rate") * 20)


def vector_health(stored: Column, reachable: Column, expected: Column, probe_ok: Column) -> Column:
    """unknown if the probe failed, missing without vectors, degraded when over 5 % can't be reached or under 80 % are stored, else ok."""
    counted = F.coalesce(stored, reachable)
    lost = (stored - reachable) / stored
    return (
        F.when(~probe_ok | counted.isNull(), "unknown")
        .when(counted == 0, "missing")
        .when((lost > 0.05) | ((expected > 0) & (counted / expected < 0.80)), "degraded")
        .otherwise("ok")
    )


def rollup_status(df: DataFrame, status: str, by: list[str]) -> DataFrame:
    """error if all are, degraded if some are, else ok; and how many are ok."""
    g = df.groupBy(*by).agg(F.count_if(F.col(status) == "error").alias("errors"), F.count("*").alias("n"))
    s = F.when(F.col("errors") == F.col("n"), "error").when(F.col("errors") > 0, "degraded").otherwise("ok")
    return g.select(*by, s.alias("status"), (F.col("n") - F.col("errors")).alias("healthy"))


def subject_clusters(entries: DataFrame, at_least: int = 2) -> DataFrame:
    """Subjects with at_least live entries: their number and the first and last id by arrival. No group's ids are gathered."""
    g = entries.where("flag is null").groupBy("subject").agg(F.count("*").alias("n"), F.min_by("id", "ord").alias("first_id"), F.max_by("id", "ord").alias("last_id"))
    return g.where(F.col("n") >= at_least)


def reconcile(entries: DataFrame, links: DataFrame) -> DataFrame:
    """By the first part of the subject: entries, superseded ones and near-duplicate links (a, b)."""
    prefix = F.split("subject", r"\.")[0].alias("prefix")
    base = entries.groupBy(prefix).agg(F.count("*").alias("entries"), F.count_if(F.col("flag") == "SUPERSEDED").alias("superseded"))
    near = links.join(entries.select(F.col("id").alias("a"), prefix), "a").groupBy("prefix").agg(F.count("*").alias("near"))
    return base.join(near, "prefix", "left").select("prefix", "entries", "superseded", F.coalesce("near", F.lit(0)).alias("near"))


def quality(items: DataFrame, by: list[str]) -> DataFrame:
    """Rates of injected items (on_topic, used, contradicted, raised_at, resolved_at): the last within 14 days of raising."""
    solved = F.col("raised_at").isNotNull() & (F.col("resolved_at") <= F.timestamp_add("DAY", F.lit(14), F.col("raised_at")))
    raised = F.count_if(F.col("raised_at").isNotNull())
    return items.groupBy(*by).agg(
        F.count("*").alias("items"),
        (F.count_if("on_topic") / F.count("*")).alias("on_topic_rate"),
        (F.count_if("used") / F.count("*")).alias("usage_rate"),
        (F.count_if("contradicted") / F.count("*")).alias("contradiction_rate"),
        F.when(raised > 0, F.count_if(solved) / raised).otherwise(0.0).alias("discovery_rate"),
    )


def effective_confidence(history: DataFrame, alpha: float = 0.5, beta: float = 2.0, gamma: float = 0.3) -> DataFrame:
    """(id, effective) from (id, day, confidence, usage, contradiction): exponential averages by day, then max(0, c (1 + alpha u - beta k)).

    An average is a sum with weights that fall by 1 - gamma a day, so it is an aggregate; no fold over ordered rows.
    The first day's value has weight 1 before decay.
    """
    order = Window.partitionBy("id").orderBy("day")
    back = F.count("*").over(Window.partitionBy("id")) - F.row_number().over(order)
    first = F.row_number().over(order) == 1
    w = F.pow(F.lit(1 - gamma), back) * F.when(first, 1.0).otherwise(gamma)
    g = history.withColumn("w", w).groupBy("id").agg(F.max("confidence").alias("c"), F.sum(F.col("w") * F.col("usage")).alias("u"), F.sum(F.col("w") * F.col("contradiction")).alias("k"))
    return g.select("id", F.greatest(F.lit(0.0), F.col("c") * (1 + alpha * F.col("u") - beta * F.col("k"))).alias("effective"))


def sessions(requests: DataFrame) -> DataFrame:
    """(session_id, requests, created_at, last_used_at) of a request log (session_id, ts)."""
    return requests.groupBy("session_id").agg(F.count("*").alias("requests"), F.min("ts").alias("created_at"), F.max("ts").alias("last_used_at"))
