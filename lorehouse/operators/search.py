"""Hybrid retrieval: arms, merge, ranks, fusion, limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine

RRF_K = 60
ARMS = ("mem0", "graph", "mongodb", "vector")


def facets(entries: DataFrame, user: str | None = None, sources: Sequence[str] = (), types: Sequence[str] = (), min_confidence: float | None = None, subjects: str | Sequence[str] = (), since: str | None = None, until: str | None = None, include_flagged: bool = False) -> DataFrame:
    """Filter entries by facets; empty lists filter nothing, time bounds are inclusive, flagged entries are hidden unless asked for."""
    out = entries if include_flagged else entries.where(F.col("flag").isNull())
    subjects = [subjects] if isinstance(subjects, str) else list(subjects)
    for wanted, rule in (
        (user is not None, F.col("user_id") == user),
        (sources, F.col("source").isin(*sources) if sources else None),
        (types, F.col("content_type").isin(*types) if types else None),
        (min_confidence is not None, F.col("confidence") >= F.lit(min_confidence)),
        (subjects, F.col("subject").isin(*subjects) if subjects else None),
        (since is not None, F.col("ts") >= F.lit(since).cast("timestamp")),
        (until is not None, F.col("ts") <= F.lit(until).cast("timestamp")),
    ):
        if wanted:
            out = out.where(rule)
    return out


def keyword_match(query: str, columns: Sequence[str] = ("content",), without: bool = True) -> Column:
    """Whether any keyword of the query is in any of the columns or of the tags; a query without keywords matches all, or, where `without` is false, as for documents, nothing."""
    words = [w.lower() for w in T.keywords(query)]
    if not words:
        return F.lit(without)
    hit = F.lit(False)
    for w in words:
        for c in columns:
            hit = hit | F.lower(c).contains(w)
        hit = hit | F.exists("tags", lambda t: F.lower(t).contains(w))  # noqa: B023
    return hit


def term_coverage(content: Column, query: str) -> Column:
    """Share of the query's words found in the content; 1 without words."""
    terms = query.lower().split()
    if not terms:
        return F.lit(1.0)
    return sum((F.lower(content).contains(t).cast("int") for t in terms), F.lit(0)) / len(terms)


def arm_terms(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The graph arm: entries by share of terms, ties by arrival."""
    scored = entries.withColumn("match_score", term_coverage(F.col("content"), query)).where("match_score > 0")
    return scored.orderBy(F.desc("match_score"), "ord").limit(limit)


def arm_keywords(entries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The document-store arm: keyword matches by confidence, then age, newest first; ties by arrival."""
    return entries.where(keyword_match(query)).orderBy(F.desc("confidence"), F.desc("ts"), "ord").limit(limit)


def live_shards(shards: DataFrame, entries: DataFrame) -> DataFrame:
    """Shards without those of a flagged parent; unknown parents, a shard's own id and null parents stay."""
    flagged = entries.where(F.col("flag").isNotNull()).select(F.col("id").alias("flagged"))
    return shards.join(flagged, (F.col("parent_id") == F.col("flagged")) & (F.col("parent_id") != F.col("id")), "left_anti")


def arm_shards(shards: DataFrame, query: str, limit: int = 10) -> DataFrame:
    scored = shards.withColumn("match_score", term_coverage(F.col("content"), query)).where("match_score > 0")
    return scored.orderBy(F.desc("match_score"), F.desc("score"), "id").limit(limit)


def arm_vector(vectors: DataFrame, query_vec: Sequence[float], limit: int = 20) -> DataFrame:
    """Rows by cosine to one query vector, ties by arrival."""
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    return vectors.withColumn("similarity", cosine(F.col("vec"), q)).orderBy(F.desc("similarity"), "ord").limit(limit)


def merge(arms: Sequence[tuple[str, DataFrame]], by: Sequence[str] = ()) -> DataFrame:
    """Union arms (id, content, confidence, ord in its arm, and refs, relationships where they have them) and merge rows of one id, or of one content where it is null; with by, those that agree in these columns.

    The longest content wins, ties to the earlier arm; confidence is the greatest; systems are listed in arm order; refs
    (array<string>) are united in that order; of relationships (an array) the first that isn't empty is kept.
    """
    none = F.array().cast("array<string>")
    kinds = next((x.dataType for _, df in arms for x in df.schema.fields if x.name == "relationships"), None)
    links = lambda df: F.col("relationships") if "relationships" in df.columns else F.lit(None).cast(kinds if kinds is not None else "array<string>")
    tagged = [
        df.select(*by, F.coalesce("id", F.md5("content")).alias("key"), "content", "confidence", F.lit(i).alias("arm"), F.lit(name).alias("system"), F.col("ord").cast("long").alias("ord"), (F.coalesce("refs", none) if "refs" in df.columns else none).alias("refs"), links(df).alias("relationships"))
        for i, (name, df) in enumerate(arms)
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy(*by, "key").agg(
        F.max_by("content", F.struct(F.length("content"), -F.col("arm"), -F.col("ord"))).alias("content"),
        F.max("confidence").alias("confidence"),
        F.transform(F.array_sort(F.collect_set(F.struct("arm", "system"))), lambda x: x["system"]).alias("systems"),
        F.min(F.struct("arm", "ord")).alias("arrival"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("arm", "ord", "refs"))), lambda x: x["refs"]))).alias("refs"),
        F.min_by("relationships", F.when(F.size("relationships") > 0, F.struct("arm", "ord"))).alias("relationships"),
    )


def linked(results: DataFrame, context: DataFrame) -> DataFrame:
    """Add linked to results (id, unique, and refs): its own id if that is an entity of the context (entity), then its references that are, each once."""
    none = F.array().cast("array<string>")
    each = results.select("id", F.posexplode(F.array_distinct(F.concat(F.array("id"), F.coalesce("refs", none)))).alias("at", "entity"))
    met = each.join(context.select("entity"), "entity", "left_semi").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias("linked"))
    return results.join(met, "id", "left").withColumn("linked", F.coalesce("linked", none))


def hydrate(hits: DataFrame, entries: DataFrame, preview: int = 80) -> DataFrame:
    """Vector hits (id, sim, preview) with their entry's content and confidence; of one without an entry the preview, and confidence 0."""
    known = entries.select("id", "content", "confidence")
    return hits.join(known, "id", "left").withColumns({"content": F.coalesce("content", F.substring("preview", 1, preview)), "confidence": F.coalesce("confidence", F.lit(0.0))}).drop("preview")


def clamp(n: int, low: int, high: int) -> int:
    """A limit that a caller asks for, kept within bounds."""
    return max(low, min(high, n))


def page(rows: DataFrame, by: Sequence[Column], after: Column | None = None, size: int = 50) -> DataFrame:
    """The first `size` rows in this order, of those for which `after` holds (such as that the order's key is over the last one seen)."""
    return (rows if after is None else rows.where(after)).orderBy(*by).limit(size)


def scored(entries: DataFrame, query: str, as_of: str) -> DataFrame:
    """Add relevance, recency and the composite score."""
    r, t = T.relevance(F.col("content"), query), T.recency(F.col("ts"), F.lit(as_of))
    return entries.withColumn("relevance", r).withColumn("recency", t).withColumn("score", T.composite(F.col("relevance"), F.col("recency"), F.col("confidence")))


def query_forms(queries: DataFrame) -> DataFrame:
    """(query_id, term, form, n_terms): every word form that a query's terms match. Terms here are of letters, digits and underscore."""
    terms = F.filter(F.array_distinct(F.split(F.lower(F.trim("query")), "[^a-z0-9_]+")), lambda t: (F.length(t) > 1) & ~t.isin(*T.STOPWORDS))
    each = queries.select("query_id", F.size(terms).alias("n_terms"), F.explode(terms).alias("term"))
    stem = F.expr("substring(term, 1, length(term) - 1)")
    forms = [F.concat(F.col("term"), F.lit(s)) for s in T.SUFFIXES] + [F.when(F.col("term").endswith("e"), F.concat(stem, F.lit(s))) for s in T.SUFFIXES]
    return each.select("query_id", "n_terms", "term", F.explode(F.array_distinct(F.filter(F.array(*forms), lambda f: f.isNotNull()))).alias("form"))


#: Query strings whose word forms are sent to all tasks; more are joined by shuffling words.
SENT_QUERIES = 10_000


def postings(entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, form, n): how often each form of the vocabulary (form, distinct) is a word of an entry's content."""
    words = entries.select("id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("form"))
    return words.join(vocabulary, "form", "left_semi").groupBy("id", "form").agg(F.count("*").alias("n"))


def relevance_batch(entries: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, id, relevance) of all pairs in which a term occurs, for many queries at once; with top, of those pairs that can be among a query's top.

    Words of the contents that no query has go first; the others are counted by entry and form, then by entry and term,
    before any of them meets the queries, so that a row costs its words and its terms' queries, not its words times
    queries. Where the forms are few nothing but counts is shuffled. The phrase is looked for only where all terms were
    found, as it holds them all, and with top only where it can lift the pair to the top of what others have without.
    """
    forms = query_forms(queries)
    few = queries.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES
    sent = F.broadcast if few else (lambda df: df)
    counts = postings(entries, sent(forms.select("form").distinct()))
    terms = counts.join(sent(forms.select("form", "term").distinct()), "form").groupBy("id", "term").agg(F.least(F.sum("n"), F.lit(5)).alias("n"))
    asked = forms.select("query_id", "term", "n_terms").distinct()
    pairs = terms.join(sent(asked), "term").groupBy("query_id", "id", "n_terms").agg(F.count("*").alias("matched"), F.sum("n").alias("fifths"))
    sizes = entries.select("id", F.length("content").alias("chars"))
    score = lambda phrase: T.relevance_of(F.col("matched"), F.col("fifths") / 5, phrase, F.col("n_terms"), F.col("chars"))
    scored = pairs.join(sizes, "id").withColumn("low", score(F.lit(False)))
    open_ = F.col("matched") == F.col("n_terms")
    if top is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("low"))
        kth = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("query_id").agg(F.min("low").alias("kth"), F.count("*").alias("n"))
        kth = kth.select("query_id", F.when(F.col("n") == top, F.col("kth") - 1e-6).otherwise(0.0).alias("kth"))  # ranks are of rounded scores
        scored = scored.join(kth, "query_id").where((F.col("low") >= F.col("kth")) | open_ & (score(F.lit(True)) >= F.col("kth"))).drop("kth")
    text = F.lower(F.trim("query"))
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), text, F.lit(r"\E(?![A-Za-z0-9_])"))
    found = F.contains(F.lower("content"), text) & F.regexp_like(F.lower("content"), pattern)
    maybe = scored.where(open_).select("query_id", "id").join(queries.where(F.length(F.trim("query")) > 3), "query_id").join(entries.select("id", "content"), "id").where(found).select("query_id", "id", F.lit(True).alias("phrase"))
    both = scored.join(maybe, ["query_id", "id"], "left")
    return both.select("query_id", "id", score(F.coalesce("phrase", F.lit(False))).alias("relevance"))


def ranked(df: DataFrame, by: Sequence[Column], name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Add a 1-based rank; by must end in a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*by)))


def rrf(lexical: DataFrame, vector: DataFrame, partition: Sequence[str] = ("query_id",), weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked arms (partition, id, lexical_rank) and (partition, id, vector_rank), to 6 places."""
    both = lexical.join(vector, [*partition, "id"], "full")
    score = sum(F.coalesce(w / (RRF_K + F.col(c)), F.lit(0.0)) for w, c in zip(weights, ("lexical_rank", "vector_rank"), strict=True))
    return both.withColumn("rrf", F.round(score, 6))


def fused_order(recency: str = "recency", lexical: str = "lexical") -> list[Column]:
    """Order of fused candidates: by score, then the newer, then the better in words, then the id by code point; nulls last."""
    return [F.desc("rrf"), F.col(recency).desc_nulls_last(), F.col(lexical).desc_nulls_last(), F.col("id").cast("binary")]


def within_budget(results: DataFrame, partition: Sequence[str], by: Sequence[Column], cost: Column, budget: int = 70 * 1024, least: int = 1) -> DataFrame:
    """The longest prefix of each partition's results, in this order, whose costs (`least` or more a row) sum to budget at most; adds place and bytes.

    No row after budget / least others can fit, so that a rank, which Spark prunes before the shuffle, leaves a bounded
    number a partition to be summed.
    """
    placed = ranked(results.withColumn("bytes", cost), by, "place", partition).where(F.col("place") <= budget // least)
    upto = Window.partitionBy(*partition).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("bytes", F.sum("bytes").over(upto)).where(F.col("bytes") <= budget)
