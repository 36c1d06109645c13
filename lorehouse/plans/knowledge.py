"""The registered queries over knowledge tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions import vectors as V
from ..operators import analytics, corrections, evaluation, gate, graph, ingest, search, similarity
from ..sources import scratch
from ..sources import tables as S
from ..streaming import streams

QUERY, USER = "with this onti", "u1"
REFUSE, CONFIRM = 0.45, 0.35
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _live(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(S.entries(spark, d))


# Search


@query
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    e = search.scored(search.facets(S.entries(spark, d), user=USER), QUERY, S.AS_OF)
    return e.orderBy(F.desc("score"), "ord").limit(10).select("id", "score")


@query
def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).select("id", F.round(T.relevance(F.col("content"), QUERY), 4).alias("relevance"))


@query
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).select("id", F.round(T.recency(F.col("ts"), F.lit(S.AS_OF)), 4).alias("recency"))


@query
def filter_facets(spark: SparkSession, d: str) -> DataFrame:
    found = search.facets(S.entries(spark, d), user=USER, sources=("technical", "personal"), types=("insight", "relationship", "procedure"), min_confidence=0.65, subjects=[f"{lang}.src{i}" for lang in ("en", "fr") for i in range(20)])
    return found.select("id", "subject")


@query
def hide_flagged(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).select("id", "content_type", "source")


@query
def time_range(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(S.entries(spark, d), since="2024-06-01", until="2024-09-30").select("id", "user_id")


@query
def keyword_or(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).where(search.keyword_match("worthless src7 a")).select("id")


@query
def document_search(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d).withColumn("title", T.topic_head(F.col("content")))
    found = e.where(search.keyword_match("onti with", ("content", "title"), without=False) & F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("src3"))))
    return found.orderBy(F.desc("ts"), "ord").limit(100).select("id", F.substring("title", 1, 20).alias("title"), T.word_count(F.col("content")).alias("words"))


@query
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).select("id", T.excerpt(F.col("content")).alias("excerpt"))


@query
def arm_term_coverage(spark: SparkSession, d: str) -> DataFrame:
    return search.arm_terms(_live(spark, d), QUERY).select("id", F.round("match_score", 4).alias("match_score"))


@query
def arm_keyword(spark: SparkSession, d: str) -> DataFrame:
    return search.arm_keywords(_live(spark, d), QUERY).select("id", "confidence")


@query
def shards_live(spark: SparkSession, d: str) -> DataFrame:
    return search.live_shards(S.shards(spark, d), S.entries(spark, d)).select("id", "parent_id")


def _arms(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    live = _live(spark, d)
    shards = search.arm_shards(search.live_shards(S.shards(spark, d), S.entries(spark, d)), QUERY)
    place = lambda *by: F.row_number().over(Window.orderBy(*by))  # noqa: E731  over the arm's ten rows
    return [
        ("mem0", shards.withColumn("ord", place(F.desc("match_score"), F.desc("score"), "id")).withColumnRenamed("score", "confidence")),
        ("graph", search.arm_terms(live, QUERY, 10).withColumn("ord", place(F.desc("match_score"), "ord")).drop("confidence").withColumnRenamed("match_score", "confidence")),
        ("mongodb", search.arm_keywords(live, QUERY, 10).withColumn("ord", place(F.desc("confidence"), F.desc("ts"), "ord"))),
    ]


@query
def merge_arms(spark: SparkSession, d: str) -> DataFrame:
    merged = search.merge(_arms(spark, d))
    return merged.select(F.col("key").alias("id"), F.length("content").alias("chars"), F.round("confidence", 4).alias("confidence"), F.array_join("systems", ",").alias("systems"))


@query
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, arm in _arms(spark, d):
        n = arm.agg(F.lit(name).alias("system"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    return V.nearest(v.select(F.col("ord").alias("query_id"), "vec"), v, 10).select("query_id", "place", "id", "sim")


@query
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    pool = v.join(search.facets(S.entries(spark, d), user=USER).select("id"), "id")
    return V.nearest(v.select(F.col("ord").alias("query_id"), "vec"), pool, 5).select("query_id", "place", "id", "sim")


@query
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = S.vectors(spark, d)
    return similarity.similar(v, v, [], CONFIRM, half=True).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d).select("id", "content_type").join(S.vectors(spark, d).select("id", "vec"), "id", "left")
    g = e.groupBy("content_type").agg(F.count("*").alias("expected"), F.count_if(V.valid(F.col("vec"), 64)).alias("stored"))
    return g.withColumn("coverage", F.round(F.col("stored") / F.col("expected"), 4)).withColumn("status", analytics.vector_health(F.col("stored"), F.col("stored"), F.col("expected"), F.lit(True)))


def _ranked_lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(query_id, id, relevance, recency, lexical_rank) for all query strings."""
    live = _live(spark, d)
    rel = search.relevance_batch(live, S.search_queries(spark, d), top=k).withColumn("relevance", F.round("relevance", 6))
    j = rel.join(live.select("id", F.round(T.recency(F.col("ts"), F.lit(S.AS_OF)), 6).alias("recency")), "id")
    return search.ranked(j, [F.desc("relevance"), F.desc("recency"), F.col("id")], "lexical_rank", ["query_id"]).where(F.col("lexical_rank") <= k)


@query
def rrf_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    lexical = _ranked_lexical(spark, d, 20)
    v, live = S.vectors(spark, d), _live(spark, d)
    pool = v.join(live.select("id"), "id")
    queries = S.search_queries(spark, d).select("query_id").join(v.select(F.col("ord").alias("query_id"), "vec"), "query_id")
    near = V.nearest(queries, pool, 20).select("query_id", "id", F.col("place").alias("vector_rank"))
    fused = search.rrf(lexical.select("query_id", "id", "lexical_rank", F.col("relevance").alias("lexical")), near)
    dated = fused.join(live.select("id", F.round(T.recency(F.col("ts"), F.lit(S.AS_OF)), 6).alias("recency")), "id")
    return search.ranked(dated, search.fused_order(), "place", ["query_id"]).where("place <= 10").select("query_id", "place", "id", "rrf")


@query
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    mine = search.facets(S.entries(spark, d), user=USER)
    e = search.scored(mine, QUERY, S.AS_OF).where("relevance > 0").withColumn("relevance", F.round("relevance", 6))
    best = e.orderBy(F.desc("score"), "ord").limit(20)
    lexical = search.ranked(best, [F.desc("score"), F.col("ord")], "lexical_rank").select(F.lit(7).cast("long").alias("query_id"), "id", "lexical_rank", F.col("relevance").alias("lexical"))
    v = S.vectors(spark, d)
    near = V.nearest(v.where("ord = 7").select(F.col("ord").alias("query_id"), "vec"), v.join(mine.select("id"), "id"), 20).select("query_id", "id", F.col("place").alias("vector_rank"))
    fused = search.rrf(lexical, near, weights=(1.0, 0.8))
    dated = fused.join(mine.select("id", F.round(T.recency(F.col("ts"), F.lit(S.AS_OF)), 6).alias("recency")), "id")
    return dated.orderBy(*search.fused_order()).limit(10).select("id", "lexical_rank", "vector_rank", "rrf")


# Rules


@query
def infer_type(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d).withColumn("i", rules.inference(F.col("content"), S.PROJECTS))
    return e.select("id", "i.content_type", F.round("i.confidence", 4).alias("confidence"), rules.inferred_source(F.col("i.project"), F.col("i.content_type")).alias("source"))


@query
def infer_tags(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d).withColumn("i", rules.inference(F.col("content"), S.PROJECTS))
    return e.select("id", F.array_join("i.tags", ",").alias("tags"), "i.temporal", F.size("i.patterns").alias("n_patterns"), F.size(rules.questions(F.col("i"))).alias("n_questions"))


@query
def suggest_relationships(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).select("id", F.array_join(rules.relationship_hints(F.col("content")), ",").alias("types"))


@query
def route_storage(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).select("id", F.array_join(rules.storage_targets(F.col("content"), F.col("content_type"), F.col("source")), ",").alias("targets"))


@query
def cache_level(spark: SparkSession, d: str) -> DataFrame:
    level = rules.cache_level(F.col("content_type"), F.col("source"), F.col("confidence"))
    return S.entries(spark, d).select("id", level.alias("level"), rules.level_ttl_minutes(level).alias("ttl_minutes"))


@query
def search_recommendation(spark: SparkSession, d: str) -> DataFrame:
    q = S.table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", F.lower("c_mktsegment"), F.lit("session"), F.col("c_name")).alias("query"))
    return q.select("c_custkey", F.array_join(rules.recommendation(F.col("query")), ",").alias("systems"))


# Gate


def _by_content(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose user, type and subject follow from the content, so that copies are one user's of one kind."""
    n = F.length("content")
    return S.entries(spark, d).withColumns({"user_id": F.concat(F.lit("u"), n % 3), "content_type": S.pick(S.CONTENT_TYPES, n % 6), "subject": F.element_at("tags", 1)})


@query
def fingerprint_dups(spark: SparkSession, d: str) -> DataFrame:
    return gate.exact(_by_content(spark, d)).where("duplicate_of is not null").select("id", "duplicate_of")


@query
def content_hash_first_wins(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    return gate.insert_if_absent(e.where("flag = 'DELETED'"), e.where("flag is null or flag <> 'DELETED'")).select("id")


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.entries(spark, d).join(S.vectors(spark, d).select("id", "vec"), "id", "left")


@query
def gate_bands(spark: SparkSession, d: str) -> DataFrame:
    e = _with_vectors(spark, d).where("flag is null and vec is not null")
    return gate.candidates(e, e, ["content_type"], REFUSE, CONFIRM).select("id", "candidate", "place", F.round("sim", 6).alias("sim"), "band")


@query
def gate_batch(spark: SparkSession, d: str) -> DataFrame:
    """The entries of cross_domain sources are there before, all others come one by one."""
    e = _by_content(spark, d).join(S.vectors(spark, d).select("id", "vec"), "id", "left").where("flag is null")
    there = F.col("source") == "cross_domain"
    return gate.decide(e.where(~there), e.where(there), ["content_type"], REFUSE, CONFIRM).withColumn("sim", F.round("sim", 6))


# Corrections


@query
def apply_updates(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    u = e.where("confidence < 0.5").select("id", F.concat("content", F.lit(" (checked)")).alias("new_content"), F.lit(0.5).alias("new_confidence"), F.lit("checked").alias("note"))
    out = corrections.update(e, u, S.AS_OF)
    return out.select("id", F.length("content").alias("chars"), "confidence", F.size("update_history").alias("updates"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query
def apply_flags(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    f = e.where("flag = 'RETRACTED'").select("id", F.lit(None).cast("string").alias("new_flag"), F.lit(None).cast("string").alias("new_successor")).union(e.where("flag = 'SUPERSEDED' and superseded_by is null").select("id", F.lit("UNVERIFIED"), F.lit(None).cast("string")))
    return corrections.flag(e, f, S.AS_OF).select("id", "flag", "superseded_by", F.date_format("flag_date", "yyyy-MM-dd").alias("day"))


@query
def supersede_batch(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    new = e.where("flag = 'DELETED'").select(F.col("id").alias("old_id"), F.concat(F.lit("n"), "id").alias("id"), *[F.col(c) for c in e.columns if c not in ("id", "flag", "flag_date", "superseded_by")], F.lit(None).cast("string").alias("flag"), F.lit(None).cast("timestamp").alias("flag_date"), F.lit(None).cast("string").alias("superseded_by"))
    return corrections.supersede(e, new, S.AS_OF).select("id", "flag", "superseded_by")


@query
def supersede_chain(spark: SparkSession, d: str) -> DataFrame:
    return corrections.supersede_pairs(S.entries(spark, d))


@query
def supersede_orphans(spark: SparkSession, d: str) -> DataFrame:
    reverse = S.edges(spark, d).where("type = 'SUPERSEDES' and dst is not null").select(F.col("dst").alias("old_id"), F.col("src").alias("new_id"), F.floor(F.col("ord") / 50).alias("ts"), "ord")
    return corrections.classify_superseded(S.entries(spark, d), reverse)


@query
def reap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return corrections.reapable(S.entries(spark, d), S.AS_OF).select("id", "flag")


@query
def reap_apply(spark: SparkSession, d: str) -> DataFrame:
    return corrections.reap(S.entries(spark, d), S.AS_OF).select("id")


# Graph


@query
def adjacency_capped(spark: SparkSession, d: str) -> DataFrame:
    r = graph.relationships(S.edges(spark, d), S.entries(spark, d))
    return r.select("node", "place", "direction", "type", "other", F.round("strength", 2).alias("strength"), F.length("preview").alias("preview_chars"))


@query
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(S.edges(spark, d))


@query
def detach_deleted(spark: SparkSession, d: str) -> DataFrame:
    gone = S.entries(spark, d).where("flag = 'DELETED'").select(F.col("id").alias("node"))
    return graph.without_node(S.edges(spark, d).where("dst is not null"), gone).groupBy("type").agg(F.count("*").alias("n"))


@query
def bfs_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(S.edges(spark, d), _live(spark, d).select(F.col("id").alias("start")))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    q = S.search_queries(spark, d)
    words = F.split("query", " ")
    return q.select(F.col("query_id").alias("entity"), F.array_join(F.slice(words, 1, 3), " ").alias("name"), F.array(F.array_join(F.slice(words, 4, 2), " ")).alias("aliases"))


@query
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(S.entries(spark, d).select("id", "content"), _entities(spark, d))


@query
def about_edges(spark: SparkSession, d: str) -> DataFrame:
    """Mentions become ABOUT edges from live entries to the entry that an entity stands for."""
    links = graph.mentions(S.entries(spark, d).select("id", "content"), _entities(spark, d))
    new = links.select(F.col("id").alias("src"), F.concat(F.lit("d"), "entity").alias("dst"), F.lit("ABOUT").alias("type"), F.lit(100).alias("strength"), F.col("entity").alias("ord"))
    out = graph.with_edges(S.edges(spark, d), new, _live(spark, d))
    return out.groupBy("type").agg(F.count("*").alias("n"))


@query
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    hits = search.scored(search.facets(e, user=USER), QUERY, S.AS_OF).orderBy(F.desc("score"), "ord").limit(10)
    hits = search.ranked(hits, [F.desc("score"), F.col("ord")], "hit").select(F.col("id").alias("node"), "hit")
    near = graph.relationships(S.edges(spark, d), e, 4).join(hits, "node")
    first = near.groupBy("other").agg(F.min(F.struct("hit", "place")).alias("arrival"))
    top = search.ranked(first, [F.col("arrival"), F.col("other")], "place").where("place <= 6")
    summary = e.select(F.col("id").alias("other"), "content_type", F.substring("content", 1, 200).alias("preview"))
    return top.join(summary, "other", "left").select(F.col("other").alias("entity"), "place", "content_type", "preview")


@query
def triggered_actions(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation")
    return n.where(T.any_word(F.col("n_name"), [w for w in "show nation_1 or NATION_23 now".split() if len(w) > 3])).select("n_nationkey")


@query
def autolink_first5(spark: SparkSession, d: str) -> DataFrame:
    e = S.entries(spark, d)
    return graph.auto_links(e, e)


# Evaluation


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rel = S.table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("quality").alias("q"))
    return _ranked_lexical(spark, d, 10).join(rel, "id", "left").select("query_id", "id", F.col("lexical_rank").alias("rank"), F.coalesce("q", F.lit(0)).alias("rel"))


@query
def precision_at_5(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.precision_at_k(_judged(spark, d), 5)


@query
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.reciprocal_rank(_judged(spark, d)).select("query_id", F.round("rr", 6).alias("rr"))


@query
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    j = scratch.cut(_judged(spark, d))  # read twice
    totals = j.groupBy("query_id").agg(F.sum("rel").alias("relevant"))
    return evaluation.ndcg_at_k(j, totals, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision at 5, reciprocal rank and nDCG at 10 of one ranking, which is made once."""
    j = scratch.cut(_judged(spark, d))
    totals = j.groupBy("query_id").agg(F.sum("rel").alias("relevant"))
    out = evaluation.precision_at_k(j, 5).join(evaluation.reciprocal_rank(j), "query_id").join(evaluation.ndcg_at_k(j, totals, 10), "query_id")
    return out.select("query_id", "precision", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"))


@query
def meta_share(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are procedures, or have French subjects, count as meta here."""
    e = S.entries(spark, d).select("id", F.col("content_type").alias("extracted_by"), "subject")
    marked = _ranked_lexical(spark, d, 10).join(e, "id").select("query_id", F.col("lexical_rank").alias("rank"), "extracted_by", "subject")
    return evaluation.meta_share(marked, 5, "procedure", ("fr.",))


def _swept(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.sweep(V.similarity_counts(S.vectors(spark, d)), 40, 120, 200, "n")


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = _swept(spark, d)
    return s.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.operating_points(_swept(spark, d))


@query
def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.histogram(V.similarity_counts(S.vectors(spark, d)), "sim", 0.2, 0.7, 20, "n")


@query
def similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.counted_summary(V.similarity_counts(S.vectors(spark, d)), "sim", "n", ["dup"])


@query
def legacy_ranker(spark: SparkSession, d: str) -> DataFrame:
    e = search.scored(search.facets(S.entries(spark, d), user=USER), QUERY, S.AS_OF).orderBy(F.desc("score"), "ord").limit(10)
    legacy = T.legacy_relevance(F.col("content"), QUERY)
    return evaluation.legacy_order(e.select(F.lit(1).alias("query_id"), "id", "ord", "confidence", legacy.alias("legacy_relevance")))


# Analytics


@query
def counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts(S.entries(spark, d), "content_type")


@query
def counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts(S.entries(spark, d), "source")


@query
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    return analytics.recent(S.entries(spark, d), "2024-12-31")


@query
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return analytics.density(S.entries(spark, d), S.edges(spark, d)).withColumn("density", F.round("density", 6))


@query
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "l2").otherwise("l1").alias("level"), (F.col("event_id") % 7 < 4).alias("hit"))
    r = analytics.cache_report(e, ["event_type"])
    return r.select("event_type", *[F.round(c, 6).alias(c) for c in ("l1_rate", "l2_rate", "efficiency", "speedup")])


@query
def subject_clusters(spark: SparkSession, d: str) -> DataFrame:
    return analytics.subject_clusters(S.entries(spark, d))


@query
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("user_id", F.when(F.col("value") > 50, "error").otherwise("ok").alias("status"))
    return analytics.rollup_status(e, "status", ["user_id"])


@query
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    n, at = F.col("event_id"), F.col("ts").cast("timestamp")
    e = S.table(spark, d, "events").select(F.date_format(at, "yyyy-MM-dd").alias("day"), (n % 4 != 0).alias("on_topic"), (n % 3 == 0).alias("used"), (n % 11 == 0).alias("contradicted"), F.when(n % 11 == 0, at).alias("raised_at"), F.when(n % 22 == 0, F.timestamp_add("DAY", (n % 30).cast("int"), at)).alias("resolved_at"))
    q = analytics.quality(e, ["day"])
    return q.select("day", "items", *[F.round(c, 6).alias(c) for c in ("on_topic_rate", "usage_rate", "contradiction_rate", "discovery_rate")])


@query
def effective_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.concat(F.lit("d"), "user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    h = e.groupBy("id", "day").agg(F.lit(0.8).alias("confidence"), (F.count_if(F.col("event_id") % 3 == 0) / F.count("*")).alias("usage"), (F.count_if(F.col("event_id") % 11 == 0) / F.count("*")).alias("contradiction"))
    return analytics.effective_confidence(h).select("id", F.round("effective", 6).alias("effective"))


@query
def cluster_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return analytics.reconcile(S.entries(spark, d), similar_pairs(spark, d))


# Ingest


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: a blank line after each sentence, every fourth line a second-level heading."""
    lines = F.split(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 4 == 3, F.concat(F.lit("## "), x)).otherwise(x))
    return S.table(spark, d, "documents").select("doc_id", F.array_join(marked, "\n\n").alias("text"))


@query
def chunk_h2(spark: SparkSession, d: str) -> DataFrame:
    return ingest.h2_sections(_markdown(spark, d), "doc_id", "text").select("id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pack_paragraphs(_markdown(spark, d), "doc_id", "text").select("id", "chunk", F.length("text").alias("chars"))


@query
def transcript_merge(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    seg = S.table(spark, d, "conversations").select(F.col("conv_id").alias("meeting"), t.alias("ord"), F.when(t % 3 == 0, "system").otherwise("microphone").alias("source"), "text", (t % 7 != 6).alias("is_final"))
    return ingest.merge_speakers(seg).select("meeting", "turn", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def claims_explode(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's first five turns as a distilled answer, of which the claims are read again."""
    t = F.col("turn")
    first = search.ranked(S.table(spark, d, "conversations"), [t], "r", ["conv_id"]).where("r <= 5")
    claim = F.struct(S.pick(ingest.CLAIM_TYPES, t % 6).alias("type"), F.col("text").alias("content"), S.pick(ingest.CONFIDENCES, t % 3).alias("qualitative_confidence"), F.array("role").alias("topics"), F.array().cast("array<string>").alias("people"))
    c = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", claim.alias("claim")))), lambda x: x["claim"]).alias("claims"))
    raw = c.select("conv_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("summary").alias("summary"), "claims")), F.lit("\n```")).alias("raw"))
    parsed = raw.select(F.col("conv_id").alias("doc"), ingest.distillation(F.col("raw")).alias("p")).select("doc", F.posexplode("p.claims").alias("ord", "claim"))
    rows = ingest.merged_claims(parsed.select("doc", "ord", "claim.*"))
    return rows.select("doc", "place", "type", rules.claim_type(F.col("type")).alias("content_type"), rules.numeric_confidence(F.col("qualitative_confidence")).alias("confidence"), F.length("content").alias("chars"))


@query
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    files = S.table(spark, d, "documents").select("doc_id", F.concat(F.lit("notes/"), n, F.lit(".md")).alias("path"), F.sha2("text", 256).alias("sha256"))
    log = files.where(n % 5 != 0).select("path", F.when(n % 7 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"), F.when(n % 13 != 0, F.concat(F.lit("w"), n)).alias("whole_doc_id"), F.when(n % 9 == 0, "failed").alias("last_error"))
    return ingest.sync_plan(files.where(ingest.importable(F.col("path"))), log)


NAMES = ("design notes.md", "weekly_standup.md", "metadata_cookbook.md", "todo-list.md", "plain file (1).md", "Überblick.md")


@query
def whole_doc_type(spark: SparkSession, d: str) -> DataFrame:
    name = S.pick(NAMES, F.col("doc_id") % 6)
    return S.table(spark, d, "documents").select("doc_id", rules.document_type(name, F.col("text")).alias("content_type"))


@query
def slugify_subject(spark: SparkSession, d: str) -> DataFrame:
    stem = F.regexp_replace(S.pick(NAMES, F.col("doc_id") % 6), r"\.md$", "")
    return S.table(spark, d, "documents").select("doc_id", F.concat_ws(".", "source", T.slug(stem)).alias("subject"), T.slug(stem, lower=True).alias("channel"), T.person_name(F.concat_ws(" ", "lang", stem)).alias("person"))


@query
def budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Each user's entries by arrival, as many as fit the budget."""
    e = S.entries(spark, d).select("user_id", "id", T.excerpt(F.col("content")).alias("excerpt"), "ord")
    return search.within_budget(e, ["user_id"], [F.col("ord")], F.octet_length(F.coalesce("excerpt", F.lit(""))) + F.octet_length("id")).select("user_id", "place", "id", "bytes")


# Streams


def _folder(spark: SparkSession) -> str:
    return f"{scratch.shared_dir(spark)}/lorehouse/streams"


@query
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run(streams.rate_windows(streams.events(spark, d), limit=2), "update", _folder(spark))
    last = out.groupBy("start", "user_id").agg(F.max("n").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n", (F.col("n") > 2).alias("limited"))


@query
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run(streams.session_counts(streams.events(spark, d)), "complete", _folder(spark))
    return out.select("user_id", "n", F.date_format("last_used", "yyyy-MM-dd HH:mm").alias("last_used"))


@query
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.run(streams.first_seen(streams.events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]), "append", _folder(spark))


@query
def watermark_incremental(spark: SparkSession, d: str) -> DataFrame:
    e = streams.events(spark, d).where("ts > timestamp '2024-01-05'").select("event_id", "user_id")
    return streams.run(e, "append", _folder(spark))


@query
def turn_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return streams.run(streams.turn_checkpoints(streams.read(spark, d, "conversations"), 2), "append", _folder(spark))


def entry(spark: SparkSession) -> DataFrame:
    return rrf_batch_topk(spark, "/root/testdata/sf0.001")
