"""The registered queries of the store: requests in batches, over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources import scratch
from ..sources import tables as S
from .knowledge import CONFIRM, REFUSE, _by_content

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f; its result is written, and what it wrote on the way is deleted."""

    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scratch.settled(lambda: f(spark, d))

    QUERIES[f.__name__] = run
    return run


def _opened(spark: SparkSession, d: str) -> tuple[store.Store, DataFrame]:
    """A store that holds the live entries of cross_domain sources, and the other live entries as plain requests."""
    e = _by_content(spark, d).join(S.vectors(spark, d).select("id", "vec"), "id", "left").where("flag is null")
    s = store.Store(spark, scratch.folder(spark), refuse=REFUSE, confirm=CONFIRM)
    there = F.col("source") == "cross_domain"
    columns = ["id", "ord", "ts", "content", "content_type", "source", "user_id", "confidence", "subject", "vec"]
    s.load(e.where(there).select(columns))
    have = set(columns)
    fields = [(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in store._schema(store.REQUEST).fields]
    return s, e.where(~there).select(fields)


@query
def store_batches(spark: SparkSession, d: str) -> DataFrame:
    """Ten batches in order of arrival: what becomes of each request, which is as if all came in one."""
    s, requests = _opened(spark, d)
    requests = scratch.cut(requests)
    edges = requests.approxQuantile("ord", [i / 10 for i in range(1, 10)], 0)
    for n in range(10):
        low, high = (edges[n - 1] if n else None), (edges[n] if n < 9 else None)
        part = requests.where((F.lit(True) if low is None else F.col("ord") > low) & (F.lit(True) if high is None else F.col("ord") <= high))
        s.apply(part, n + 1)
    scratch.discard(requests)
    return s.decisions().select("id", "status", "entry_id", "against", "kind", F.round("sim", 6).alias("sim"))


@query
def store_applied(spark: SparkSession, d: str) -> DataFrame:
    """The entries after four batches of updates, supersessions, complements and forced entries, one an event, many of them on one entry."""
    s = store.Store(spark, scratch.folder(spark))
    e = S.entries(spark, d)
    s.load(e.select("id", "ord", "ts", "content", "content_type", "source", "user_id", "confidence", "subject", "flag", "flag_date", "superseded_by"))
    n = F.col("event_id")
    text = n.cast("string")
    requests = S.table(spark, d, "events").select(
        F.concat(F.lit("n"), text).alias("id"),
        (n + 1_000_000_000).alias("ord"),
        F.lit(S.AS_OF).cast("timestamp").alias("ts"),
        F.concat(F.lit("note "), text).alias("content"),
        F.lit("fact").alias("content_type"),
        F.lit("personal").alias("source"),
        F.lit("u0").alias("user_id"),
        F.when(n % 3 == 0, 0.3).alias("confidence"),
        F.when(n % 5 == 0, F.concat(F.lit("s"), (n % 7).cast("string"))).alias("subject"),
        F.create_map(F.concat(F.lit("k"), (n % 3).cast("string")), text, F.lit("last"), (n % 11).cast("string")).alias("metadata"),
        F.lit(None).cast("array<double>").alias("vec"),
        S.pick(("update", "supersede", "complement", "force-new"), n % 4).alias("action"),
        F.concat(F.lit("d"), (F.when(n % 3 == 0, n % 5).otherwise(n * 7 % 260)).cast("string")).alias("target_id"),
        F.when(n % 13 != 0, F.concat(F.lit("r"), text)).alias("reason"),
        F.lit(False).alias("skip_dedup"),
    )
    for b in range(4):
        s.apply(requests.where(F.floor(n % 100 / 25) == b), b + 1)
    joined = lambda c: F.array_join(c, ",")
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return s.entries().select("id", F.length("content").alias("chars"), F.round("confidence", 6).alias("confidence"), "subject", "flag", "superseded_by", "flag_note", joined(pairs).alias("metadata"), joined("related_to").alias("related_to"), joined("update_history.reason").alias("reasons"))
