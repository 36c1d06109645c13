"""The registered queries of the vector index, of searches from end to end, of entities around hits, and of rules by their branches, over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions import vectors as V
from ..operators import graph, search, unified
from ..operators.vector_index import VectorIndex
from ..sources import readers, scratch
from ..sources import tables as S
from .knowledge import _entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f; its result is written, and what it wrote on the way is deleted."""

    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scratch.settled(lambda: f(spark, d))

    QUERIES[f.__name__] = run
    return run


@query
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all rows for each row, by the lists of a written index and their bounds."""
    v = S.vectors(spark, d)
    index = VectorIndex.build(v, scratch.folder(spark))
    return index.exact(v.select(F.col("ord").alias("query_id"), "vec"), 10).select("query_id", "place", "id", "sim")


@query
def vector_index_grown(spark: SparkSession, d: str) -> DataFrame:
    """The same with an index of two thirds of the rows, to which the others were added."""
    v = S.vectors(spark, d)
    index = VectorIndex.build(v.where("ord % 3 > 0"), scratch.folder(spark))
    index.add(v.where("ord % 3 = 0"))
    return index.exact(v.select(F.col("ord").alias("query_id"), "vec"), 10).select("query_id", "place", "id", "sim")


@query
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same from as many lists only as a calibration takes for a recall of 0.95."""
    v = S.vectors(spark, d)
    queries = v.select(F.col("ord").alias("query_id"), "vec")
    index = VectorIndex.build(v, scratch.folder(spark))
    return index.search(queries, 10, index.calibrated(queries, 10)).select("query_id", "place", "id", "sim")


@query
def related_paths(spark: SparkSession, d: str) -> DataFrame:
    """Of all live entries, what is within two steps, by which edge it was found, and that edge's strength."""
    live = S.entries(spark, d).where("flag is null").select(F.col("id").alias("start"))
    return graph.related_paths(S.edges(spark, d), live).select("start", "node", "distance", "parent", F.round("strength", 4).alias("strength"), "place")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled nodes: most entries have one label, some two, some none, and a few labels belong to no entry."""
    n = F.col("doc_id")
    labels = graph.LABELS + graph.OPERATIONAL[:2]
    t = S.table(spark, d, "documents").select("doc_id")
    own = t.where(n % 7 != 3).select(F.concat(F.lit("d"), n).alias("id"), S.pick(labels, n % 10).alias("label"))
    more = t.where(n % 5 == 1).select(F.concat(F.lit("d"), n).alias("id"), S.pick(labels, (n + 4) % 10).alias("label"))
    bare = t.where(n % 50 == 0).select(F.concat(F.lit("x"), n).alias("id"), F.lit("Person").alias("label"))
    return own.unionByName(more).unionByName(bare)


@query
def entity_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A card for every entry, and for ids that are nodes alone or nothing at all."""
    n = F.col("doc_id")
    ids = S.table(spark, d, "documents").select(F.when(n % 25 == 0, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit("d"), n)).alias("id"))
    cards = graph.summaries(ids, _nodes(spark, d), S.edges(spark, d), S.entries(spark, d))
    names = F.array_join(F.transform("related", lambda x: F.concat_ws("=", x["id"], F.length(x["name"]).cast("string"))), ",")
    return cards.select("id", "name", "type", F.sha2("summary", 256).alias("summary_sha"), names.alias("related"))


@query
def entity_cards(spark: SparkSession, d: str) -> DataFrame:
    """The hits of all query strings in three arms, what entities these lead to, and which of them each hit links to."""
    e = S.entries(spark, d)
    n = F.col("ord")
    labels = _nodes(spark, d).groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    known = e.join(labels, "id", "left").select("id", "labels", F.when(n % 3 != 0, F.array(F.concat(F.lit("d"), n * 7 % 40), F.concat(F.lit("d"), n * 3 % 20))).alias("refs"), n.alias("n"))
    q = S.search_queries(spark, d).select("query_id")
    # each query meets nine entries, three an arm
    at = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("n", (F.col("query_id") * 13 + F.col("j") * 11) % 150)
    hits = at.join(known, "n").select("query_id", S.pick(("graph", "mongodb", "mem0"), F.col("j") % 3).alias("arm"), F.floor(F.col("j") / 3).cast("int").alias("place"), "id", "labels", "refs")
    hits = scratch.cut(hits)
    entities = scratch.cut(graph.context(hits))
    linked = graph.annotated(hits, entities).select("query_id", F.concat("arm", "place").alias("what"), "id", F.array_join("linked", ",").alias("linked"))
    return linked.unionByName(entities.select("query_id", F.concat(F.lit("entity"), "place").alias("what"), "id", F.lit("").alias("linked")))


def _search(spark: SparkSession, d: str, hybrid: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All query strings, with an entry's vector each, over all tables."""
    n = F.col("ord")
    e = S.entries(spark, d).withColumn("refs", F.when(n % 3 != 0, F.array(F.concat(F.lit("d"), n * 7 % 40), F.concat(F.lit("d"), n * 3 % 20))).otherwise(F.array().cast("array<string>")))
    v = S.vectors(spark, d)
    queries = S.search_queries(spark, d).join(v.select(F.col("ord").alias("query_id"), "vec"), "query_id", "left")
    tables = unified.Tables(e, S.shards(spark, d), v.select("id", "vec"), _nodes(spark, d), S.edges(spark, d))
    return unified.search_batch(scratch.cut(queries), tables, unified.Options(S.AS_OF, {"min_confidence": 0.5}, hybrid))


@query
def unified_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """One search from end to end for all query strings, ranks fused."""
    results, _, _ = _search(spark, d, True)
    return results.select("query_id", "place", "id", "score", "relevance", "recency", F.round("confidence", 6).alias("confidence"), F.array_join("systems", ",").alias("systems"), "lexical_rank", "vector_rank", F.array_join("linked", ",").alias("linked"))


@query
def unified_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The same by the lexical score alone."""
    results, _, _ = _search(spark, d, False)
    return results.select("query_id", "place", "id", "score", "relevance", "recency", F.round("confidence", 6).alias("confidence"), F.array_join("systems", ",").alias("systems"), F.array_join("linked", ",").alias("linked"))


@query
def unified_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each arm found of each query, and how many entities that leads to."""
    _, cards, counts = _search(spark, d, True)
    return counts.unionByName(cards.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("system", F.lit("entities")))


@query
def model_links(spark: SparkSession, d: str) -> DataFrame:
    """What all entries are about: a model's answers for a third of them, of which some name no entity, and mentions for the others."""
    n = F.col("ord")
    e = S.entries(spark, d)
    entities = _entities(spark, d)
    answers = e.where(n % 3 == 0).select("id", F.when(n % 2 == 0, F.array(n % 40, n % 7 + 100_000, n % 40)).alias("found"))
    refs = graph.entity_refs(e.select("id", "content"), entities, answers)
    return refs.select("id", "entity", "how")


@query
def default_bands(spark: SparkSession, d: str) -> DataFrame:
    """The gate's bands by content type, without an override, with one, and with one that doesn't hold, for similarities from the labelled vectors."""
    e = S.entries(spark, d).select("id", "content_type")
    v = S.vectors(spark, d).withColumn("sim", F.round(F.lit(0.75) + F.abs(F.col("vec")[0]), 6)).select("id", "sim").join(e, "id")
    kinds = {"plain": (None, None), "override": (0.9, 0.8), "half": (0.9, None), "crossed": (0.7, 0.8)}
    bands = [rules.band(F.col("sim"), *rules.thresholds(F.col("content_type"), *given)).alias(name) for name, given in kinds.items()]
    return v.select("id", *bands)


@query
def claim_types(spark: SparkSession, d: str) -> DataFrame:
    """A claim of every kind a conversation turn, as the importers of either variant take it."""
    c = S.table(spark, d, "conversations")
    kind = S.pick(("decision", "preference", "learning", "context", "brainstorm", "reference", "other"), (F.col("conv_id") + F.col("turn")) % 7)
    return c.select("conv_id", "turn", rules.claim_type(kind).alias("as_insight"), rules.claim_type(kind, "fact").alias("as_fact"))


@query
def neighbour_cosines(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of each vector and the one with the next id, also of a zero vector."""
    v = S.vectors(spark, d).select("ord", F.when(F.col("ord") % 50 == 7, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec")).alias("vec"))
    after = v.select((F.col("ord") - 1).alias("ord"), F.col("vec").alias("other"))
    return v.join(after, "ord").select("ord", F.round(V.cosine(F.col("vec"), F.col("other")), 6).alias("sim"))


@query
def calibration_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entries with a label by hand or none, written as JSON lines and read again, and relabelled by their ids' heads."""
    e = S.entries(spark, d).select("id", "ord", "subject", "content_type", F.substring("content", 1, 80).alias("content"))
    b = e.select((F.col("ord") - 1).alias("ord"), *[F.col(c).alias(f"{c}_b") for c in ("id", "subject", "content_type", "content")])
    n = F.col("ord")
    pairs = e.join(b, "ord").select(F.col("id").alias("id_a"), "id_b", F.col("subject").alias("subject_a"), "subject_b", "content_type", "content_type_b", F.col("content").alias("content_a"), "content_b", F.round(n % 100 / 100, 2).alias("sim_observed"), F.when(n % 3 == 0, "duplicate").when(n % 3 == 1, "distinct").alias("human_label"))
    folder = scratch.folder(spark)
    readers.write_pairs(pairs, folder)
    back = readers.read_pairs(spark, folder, "id_a string, id_b string, subject_a string, subject_b string, content_type string, content_type_b string, content_a string, content_b string, sim_observed double, human_label string")
    return back.select("id_a", "id_b", "sim_observed", "human_label", F.sha2(F.concat("content_a", F.lit("|"), "content_b"), 256).alias("sha"), "_problem")


@query
def meeting_dump_import(spark: SparkSession, d: str) -> DataFrame:
    """All conversations as five dumps of meetings, of which one has a meeting without a title and one isn't an array."""
    c = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("transcript"))
    n = F.col("conv_id")
    meeting = F.struct(F.concat(F.lit("m"), n).alias("id"), F.when((n % 5 != 3) | (n > 5), F.concat(F.lit("talk "), n)).alias("title"), F.when(n % 2 == 0, "2024-05-01").alias("date"), "transcript")
    files = c.groupBy((n % 5).alias("k")).agg(F.to_json(F.collect_list(meeting)).alias("json"))
    folder = scratch.folder(spark)
    readers.register(spark)
    files.select(F.concat(F.lit("dump-"), "k", F.lit(".json")).alias("path"), F.when(F.col("k") == 4, F.concat(F.lit('{"meetings": '), "json", F.lit("}"))).otherwise(F.col("json")).alias("content")).write.format("text_files").option("path", folder).mode("append").save()
    meetings, problems = readers.meeting_dump(spark, folder)
    out = meetings.select("id", "title", "date", F.sha2("transcript", 256).alias("sha"), F.lit(None).cast("string").alias("problem"))
    none = [F.lit(None).cast("string").alias(x) for x in ("id", "title", "date", "sha")]
    return out.unionByName(problems.select(*none, "problem").distinct())


@query
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """The newest documents under limits that are asked for: none, a page, and more than are given."""
    e = S.entries(spark, d).withColumn("title", T.topic_head(F.col("content")))
    out = None
    for asked in (0, 7, 250):
        found = e.where(search.keyword_match("er", ("content", "title"), without=False))
        rows = search.page(found, [F.desc("ts"), F.col("ord")], size=search.clamp(asked, 1, 100)).select(F.lit(asked).alias("asked"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out
