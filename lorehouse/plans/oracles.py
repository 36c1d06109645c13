"""DuckDB SQL for those knowledge queries that SQL can express plainly."""

from ..functions import rules, text
from ..sources import tables

#: The derived tables, as in sources.tables.
TABLES = """
WITH e AS (
  SELECT 'd' || d.doc_id AS id, d.doc_id AS ord, d.text AS content,
    ['memory', 'insight', 'pattern', 'relationship', 'fact', 'procedure'][(d.doc_id % 6 + 1)::INT] AS content_type,
    ['personal', 'technical', 'cross_domain'][((d.doc_id // 6) % 3 + 1)::INT] AS source,
    'u' || (d.doc_id % 4) AS user_id,
    CASE l.quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.4 ELSE 0.65 END::DOUBLE AS confidence,
    TIMESTAMP '2024-01-01' + to_days(((d.doc_id * 7919) % 400)::INT) AS ts,
    CASE WHEN d.doc_id % 17 = 0 THEN 'SUPERSEDED' WHEN d.doc_id % 23 = 0 THEN 'DELETED' WHEN d.doc_id % 29 = 0 THEN 'RETRACTED' END AS flag,
    CASE WHEN d.doc_id % 17 = 0 OR d.doc_id % 23 = 0 OR d.doc_id % 29 = 0 THEN TIMESTAMP '2024-01-31' + to_days(((d.doc_id * 7919) % 400)::INT) END AS flag_date,
    CASE WHEN d.doc_id % 17 = 0 AND d.doc_id % 34 <> 0 THEN 'd' || CASE WHEN d.doc_id % 51 = 0 THEN d.doc_id + 10000000 ELSE d.doc_id + 1 END END AS superseded_by,
    concat_ws('.', d.lang, d.source) AS subject, [d.lang, d.source] AS tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), base AS (
  SELECT 'd' || doc_id AS src, CASE WHEN doc_id % 97 <> 0 THEN 'd' || ((doc_id * 31 + 7) % (SELECT count(*) FROM documents)) END AS dst,
    ['RELATED_TO', 'ABOUT', 'SOLVES', 'REQUIRES', 'SUPERSEDES'][(doc_id % 5 + 1)::INT] AS type, (doc_id * 37) % 101 AS strength, doc_id * 3 AS ord, doc_id AS k
  FROM documents
), g AS (
  SELECT src, dst, type, strength, ord FROM base
  UNION ALL SELECT src, dst, type, strength, ord + 1 FROM base WHERE k % 11 = 0
  UNION ALL SELECT src, 'd0', type, strength, ord + 2 FROM base WHERE k % 5 = 0
), u AS (SELECT * FROM g WHERE src IS NOT NULL AND dst IS NOT NULL
), adj AS (
  SELECT src AS node, dst AS other, 'out' AS direction, type, strength, ord FROM u
  UNION ALL SELECT dst, src, 'in', type, strength, ord FROM u
), s AS (
  SELECT 'm_' || conv_id || '_' || turn AS id,
    CASE WHEN conv_id % 19 = 0 THEN NULL WHEN turn = 0 AND conv_id % 13 = 0 THEN 'm_' || conv_id || '_' || turn ELSE 'd' || (conv_id % (SELECT count(*) FROM documents)) END AS parent_id,
    text AS content, (turn % 10) / 10 AS score
  FROM conversations
), v AS (
  SELECT 'd' || vec_id AS id, vec_id AS ord, embedding::DOUBLE[] AS vec, label FROM embeddings
), sims AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS dup, greatest(-1, least(1, list_cosine_similarity(a.vec, b.vec))) AS sim FROM v a JOIN v b ON a.id < b.id
)
"""

_RELEVANT = """
, t(term, pat) AS (VALUES ('with', '\\bwith(?:s|es|ed|ing)?\\b'), ('this', '\\bthis(?:s|es|ed|ing)?\\b'), ('onti', '\\bonti(?:s|es|ed|ing)?\\b')),
c AS (SELECT e.id, e.content, len(regexp_extract_all(lower(e.content), t.pat)) AS n FROM e, t),
r AS (
  SELECT id, least(1.0::DOUBLE, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) / 3.0::DOUBLE * 0.7::DOUBLE + sum(least(n, 5) / 5.0::DOUBLE) / 3.0::DOUBLE * 0.15::DOUBLE
      + CASE WHEN regexp_matches(lower(any_value(content)), '\\bwith this onti\\b') THEN 0.15::DOUBLE ELSE 0 END)
    * CASE WHEN length(any_value(content)) <= 500 THEN 1 ELSE greatest(0.6::DOUBLE, 1 / (1 + log10(length(any_value(content)) / 500.0::DOUBLE))) END AS relevance
  FROM c GROUP BY id
)
"""
_RECENCY = "CASE WHEN e.ts IS NULL THEN 0.5 WHEN e.ts > TIMESTAMP '2025-03-01' THEN 1 ELSE pow(0.5, (epoch_us(TIMESTAMP '2025-03-01') - epoch_us(e.ts)) / 86400000000 / 90) END"
_LEVELS = """
, x AS (SELECT 40 + i AS i FROM range(81) q(i)),
w AS (
  SELECT i / 200 AS threshold, (SELECT count(*) FROM p WHERE dup AND floor(sim * 200) >= i) AS tp, (SELECT count(*) FROM p WHERE NOT dup AND floor(sim * 200) >= i) AS fp, (SELECT count(*) FROM p WHERE dup) AS dups FROM x
), y AS (
  SELECT threshold, tp, fp, dups - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN dups > 0 THEN tp / dups ELSE 0 END AS recall FROM w
), z AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM y
)
"""
_PAIRS = ", p AS (SELECT a, b, dup, round(sim, 6) AS sim FROM sims)"
_HITS = _RELEVANT + f", hit AS (SELECT e.*, relevance, {_RECENCY} AS recency, round(0.70::DOUBLE * relevance + 0.25::DOUBLE * ({_RECENCY}) + 0.05::DOUBLE * confidence, 4) AS score FROM e JOIN r USING (id) WHERE flag IS NULL AND user_id = 'u1')"

#: Query strings, the word forms that their terms match, and every pair's relevance; ranks by relevance, recency and id.
_STRINGS = r", sq AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '\b[a-z]{2,}\b')[1:5], ' ') AS query FROM benchmark)"
_RANKED = (
    _STRINGS
    + f"""
, qt AS (
  SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM (
    SELECT query_id, list_distinct(list_filter(string_split_regex(lower(trim(query)), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND t NOT IN {text.STOPWORDS})) AS terms FROM sq)
), qf AS (
  SELECT DISTINCT query_id, n_terms, term, unnest(list_transform({list(text.SUFFIXES)}, lambda s: term || s) || CASE WHEN suffix(term, 'e') THEN list_transform({list(text.SUFFIXES)}, lambda s: term[:-2] || s) ELSE [] END) AS form FROM qt
), wd AS (
  SELECT id, form, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS form FROM e WHERE flag IS NULL) GROUP BY ALL
), tc AS (
  SELECT query_id, id, term, n_terms, sum(n) AS n FROM wd JOIN qf USING (form) GROUP BY ALL
), pc AS (
  SELECT query_id, id, n_terms, count(*) AS matched, sum(least(n, 5)) AS fifths FROM tc GROUP BY ALL
), sc AS (
  SELECT pc.query_id, e.id, round({_RECENCY}, 6) AS recency,
    round(least(1.0::DOUBLE, matched::DOUBLE / n_terms * 0.7::DOUBLE + fifths::DOUBLE / 5 / n_terms * 0.15::DOUBLE
      + CASE WHEN length(trim(query)) > 3 AND contains(lower(content), lower(trim(query))) AND regexp_matches(lower(content), '\\b' || lower(trim(query)) || '\\b') THEN 0.15::DOUBLE ELSE 0 END)
    * CASE WHEN length(content) <= 500 THEN 1 ELSE greatest(0.6::DOUBLE, 1 / (1 + log10(length(content) / 500.0::DOUBLE))) END, 6) AS relevance
  FROM pc JOIN e USING (id) JOIN sq USING (query_id)
), rk AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, recency DESC, id)::INT AS lexical_rank FROM sc
), jd AS (
  SELECT query_id, rk.id, lexical_rank AS rank, coalesce(quality, 0) AS rel FROM rk LEFT JOIN labels ON rk.id = 'd' || labels.doc_id WHERE lexical_rank <= 10
)
"""
)

_ARMS = """
, cov AS (
  SELECT *, (contains(lower(content), 'with')::INT + contains(lower(content), 'this')::INT + contains(lower(content), 'onti')::INT) / 3.0::DOUBLE AS hit FROM e WHERE flag IS NULL
), m1 AS (
  SELECT id, content, score AS confidence, 0 AS arm, 'mem0' AS system, row_number() OVER (ORDER BY hit DESC, score DESC, id) AS ord FROM (
    SELECT *, (contains(lower(content), 'with')::INT + contains(lower(content), 'this')::INT + contains(lower(content), 'onti')::INT) / 3.0::DOUBLE AS hit FROM s
    WHERE parent_id IS NULL OR parent_id = id OR parent_id NOT IN (SELECT id FROM e WHERE flag IS NOT NULL)) WHERE hit > 0 QUALIFY ord <= 10
), m2 AS (
  SELECT id, content, hit AS confidence, 1 AS arm, 'graph' AS system, row_number() OVER (ORDER BY hit DESC, ord) AS place FROM cov WHERE hit > 0 QUALIFY place <= 10
), m3 AS (
  SELECT id, content, confidence, 2 AS arm, 'mongodb' AS system, row_number() OVER (ORDER BY confidence DESC, ts DESC, ord) AS place FROM cov
  WHERE hit > 0 OR len(list_filter(tags, lambda t: contains(lower(t), 'with') OR contains(lower(t), 'this') OR contains(lower(t), 'onti'))) > 0 QUALIFY place <= 10
), arms AS (
  SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3
)
"""

_H = r"[ \t\f\x0B\x{A0}]"
_TRIMMED = r"regexp_replace({}, '\A[\s\x{{A0}}]+|[\s\x{{A0}}]+\z', '', 'g')"
#: Entries whose user, type and subject follow from the content, with the normalised content.
_BY_CONTENT = (
    ", bc AS (SELECT id, ord, flag, 'u' || (length(content) % 3) AS user_id, ['memory', 'insight', 'pattern', 'relationship', 'fact', 'procedure'][(length(content) % 6 + 1)::INT] AS content_type, tags[1] AS subject, "
    rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '(?m){_H}+$', '', 'g'), '([^\n{_H[1:]}){_H}+', '\1 ', 'g'), '\A\n+|\n+\z', '', 'g') AS norm FROM e)"
)

_ADJ_PLACED = ", ad AS (SELECT node, direction, type, other, min((ord, strength)) AS m FROM adj GROUP BY ALL), ap AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY direction DESC, m[1], type, other)::INT AS place FROM ad)"
_ENTITIES = (
    _STRINGS
    + ", en AS (SELECT query_id AS entity, lower(unnest([array_to_string(string_split(query, ' ')[1:3], ' '), array_to_string(string_split(query, ' ')[4:5], ' ')])) AS name FROM sq), el AS (SELECT DISTINCT e.id, entity FROM e JOIN en ON length(name) > 3 AND contains(lower(e.content), name))"
)


def _holds(pattern: str) -> str:
    return f"regexp_matches(content, '(?i){pattern}')"


def _case(patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(p)} THEN '{name}'" for name, p in patterns.items()) + " END"


_SCORES = {t: f"({' + '.join(_holds(p) + '::INT' for p in ps)}) / {len(ps)}.0::DOUBLE" for t, ps in rules.TYPE_PATTERNS.items()}
_INFERRED = f"""
, ec AS (SELECT id, coalesce(content, '') AS content FROM e
), i1 AS (
  SELECT id, content, {", ".join(f"{x} AS s_{t}" for t, x in _SCORES.items())}, {_case(tables.PROJECTS)} AS project, {_case(rules.LANGUAGES)} AS language, {_case(rules.TIMES)} AS temporal,
    list_filter([{", ".join(f"CASE WHEN {_holds(p)} THEN '{name}' END" for name, p in rules.FRAMEWORKS.items())}], lambda x: x IS NOT NULL) AS frameworks FROM ec
), i2 AS (
  SELECT *, greatest({", ".join(f"s_{t}" for t in _SCORES)}) AS best FROM i1
), i3 AS (
  SELECT *, CASE WHEN best = 0 THEN 'fact' {" ".join(f"WHEN s_{t} = best THEN '{t}'" for t in _SCORES)} END AS content_type, least(0.9::DOUBLE, 0.5::DOUBLE + best * 0.4::DOUBLE) AS confidence FROM i2
), i4 AS (
  SELECT *, list_filter([lower(project), language] || frameworks || [content_type, temporal], lambda x: x IS NOT NULL) AS tags FROM i3
)
"""

_NAMES = "[" + ", ".join(f"'{x}'" for x in ("design notes.md", "weekly_standup.md", "metadata_cookbook.md", "todo-list.md", "plain file (1).md", "Überblick.md")) + "][(doc_id % 6 + 1)::INT]"


def _word_in(words: str) -> str:
    return f"regexp_matches(lower({_NAMES}), '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


_QUERIES = {
    "budget_truncate": """, bx AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ord)::INT AS place, strlen(coalesce(substr(content, 1, 300) || CASE WHEN length(content) > 300 THEN '…' ELSE '' END, '')) + strlen(id) AS b FROM e), bt AS (
      SELECT user_id, place, id, (sum(b) OVER (PARTITION BY user_id ORDER BY place))::BIGINT AS bytes FROM bx) SELECT * FROM bt WHERE bytes <= 71680""",
    "infer_tags": _INFERRED + f"""SELECT id, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ',') AS tags, temporal, least(3, len(regexp_extract_all(content, '(?i){rules.HABIT}')))::INT AS n_patterns,
      ((project IS NULL AND content_type = 'procedure')::INT + (confidence < 0.7::DOUBLE)::INT + (len(frameworks) > 2)::INT + (temporal IS NULL AND content_type = 'insight')::INT) AS n_questions FROM i4""",
    "infer_type": _INFERRED + "SELECT id, content_type, round(confidence, 4) AS confidence, CASE WHEN project IS NOT NULL THEN 'technical' WHEN content_type IN ('memory', 'insight') THEN 'personal' ELSE 'cross_domain' END AS source FROM i4",
    "entity_context": _HITS + _ADJ_PLACED + """, th AS (SELECT id AS node, row_number() OVER (ORDER BY score DESC, ord) AS hit FROM hit), ar AS (
      SELECT other, min((hit, place)) AS arrival FROM ap JOIN th USING (node) WHERE place <= 4 AND hit <= 10 GROUP BY other), tp AS (SELECT *, row_number() OVER (ORDER BY arrival, other)::INT AS place FROM ar)
      SELECT other AS entity, tp.place, e.content_type, substr(e.content, 1, 200) AS preview FROM tp LEFT JOIN e ON e.id = other WHERE tp.place <= 6""",
    "about_edges": _ENTITIES + "SELECT type, count(*) AS n FROM (SELECT type FROM g UNION ALL SELECT 'ABOUT' FROM el WHERE id IN (SELECT id FROM e WHERE flag IS NULL) AND 'd' || entity IN (SELECT id FROM e WHERE flag IS NULL)) GROUP BY type",
    "entity_links": _ENTITIES + "SELECT id, entity FROM el",
    "gate_bands": """, pb AS (SELECT a, b, sim FROM sims WHERE sim >= 0.35 UNION ALL SELECT b, a, sim FROM sims WHERE sim >= 0.35), pt AS (
      SELECT x.id, y.id AS candidate, sim, row_number() OVER (PARTITION BY x.id ORDER BY sim DESC, y.id)::INT AS place FROM pb JOIN e x ON x.id = a JOIN e y ON y.id = b WHERE x.flag IS NULL AND y.flag IS NULL AND x.content_type = y.content_type)
      SELECT id, candidate, place, round(sim, 6) AS sim, CASE WHEN sim >= 0.45 THEN 'refuse' ELSE 'confirm' END AS band FROM pt WHERE place <= 5""",
    "content_hash_first_wins": f", ch AS (SELECT id, ord, flag, substr(lower({_TRIMMED.format('content')}), 1, 300) AS h FROM e) SELECT arg_min(id, ord) AS id FROM ch WHERE flag IS DISTINCT FROM 'DELETED' AND h NOT IN (SELECT h FROM ch WHERE flag = 'DELETED') GROUP BY h",
    "fingerprint_dups": _BY_CONTENT + ", fd AS (SELECT norm, user_id, content_type, subject, arg_min(id, ord) AS first_id FROM bc WHERE flag IS NULL GROUP BY ALL) SELECT id, first_id AS duplicate_of FROM bc JOIN fd ON bc.norm = fd.norm AND bc.user_id = fd.user_id AND bc.content_type = fd.content_type AND bc.subject IS NOT DISTINCT FROM fd.subject WHERE flag IS NULL AND id <> first_id",
    "meta_share": _RANKED + "SELECT query_id, count(*) FILTER (WHERE rank <= 5 AND coalesce(content_type = 'procedure' OR starts_with(subject, 'fr.'), false)) / 5.0::DOUBLE AS share FROM jd JOIN e USING (id) GROUP BY query_id",
    "ndcg_at_10": _RANKED + "SELECT query_id, round(coalesce(sum(CASE WHEN rel > 0 THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= sum(rel)), 0), 6) AS ndcg FROM jd GROUP BY query_id",
    "ranking_metrics": _RANKED
    + """SELECT query_id, count(*) FILTER (WHERE rank <= 5 AND rel > 0) / 5.0::DOUBLE AS precision, round(coalesce(1 / min(rank) FILTER (WHERE rel > 0), 0), 6)::DOUBLE AS rr,
  round(coalesce(sum(CASE WHEN rel > 0 THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= sum(rel)), 0), 6) AS ndcg FROM jd GROUP BY query_id""",
    "mrr": _RANKED + "SELECT query_id, round(coalesce(1 / min(rank) FILTER (WHERE rel > 0), 0), 6)::DOUBLE AS rr FROM jd GROUP BY query_id",
    "precision_at_5": _RANKED + "SELECT query_id, count(*) FILTER (WHERE rank <= 5 AND rel > 0) / 5.0::DOUBLE AS precision FROM jd GROUP BY query_id",
    "hybrid_rrf": _HITS + """, lx AS (SELECT id, round(relevance, 6) AS lexical, row_number() OVER (ORDER BY score DESC, ord)::INT AS lexical_rank FROM hit WHERE relevance > 0),
      nr AS (SELECT b.id, row_number() OVER (ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id)::INT AS vector_rank FROM v a, v b JOIN e ON e.id = b.id WHERE a.ord = 7 AND e.flag IS NULL AND e.user_id = 'u1')
      SELECT id, lexical_rank, vector_rank, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(0.8::DOUBLE / (60 + vector_rank), 0), 6) AS rrf
      FROM (SELECT * FROM lx WHERE lexical_rank <= 20) FULL JOIN (SELECT * FROM nr WHERE vector_rank <= 20) USING (id) JOIN e USING (id)
      ORDER BY rrf DESC, round(""" + _RECENCY + """, 6) DESC, lexical DESC NULLS LAST, id LIMIT 10""",
    "rrf_batch_topk": _RANKED + """, nr AS (SELECT sq.query_id, b.id, row_number() OVER (PARTITION BY sq.query_id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id) AS vector_rank FROM sq JOIN v a ON a.ord = sq.query_id, v b JOIN e ON e.id = b.id WHERE e.flag IS NULL),
      fu AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 6) AS rrf, relevance AS lexical
        FROM (SELECT * FROM rk WHERE lexical_rank <= 20) FULL JOIN (SELECT * FROM nr WHERE vector_rank <= 20) USING (query_id, id)),
      pl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, round(""" + _RECENCY + """, 6) DESC, lexical DESC NULLS LAST, fu.id)::INT AS place, fu.id, rrf FROM fu JOIN e ON e.id = fu.id)
      SELECT * FROM pl WHERE place <= 10""",
    "source_counts": _ARMS + "SELECT x AS system, (SELECT count(*) FROM arms WHERE system = x) AS n FROM (SELECT unnest(['mem0', 'graph', 'mongodb']) AS x)",
    "merge_arms": _ARMS + "SELECT coalesce(id, md5(content)) AS id, length(arg_max(content, (length(content), -arm, -ord))) AS chars, round(max(confidence), 4) AS confidence, string_agg(DISTINCT system, ',' ORDER BY array_position(['mem0', 'graph', 'mongodb'], system)) AS systems FROM arms GROUP BY 1",
    "document_search": r"""SELECT id, substr(title, 1, 20) AS title, len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS words FROM (
      SELECT *, CASE WHEN regexp_extract(t, '^([\w''-]+(?:\s[\w''-]+){2,4})', 1) <> '' THEN substr(regexp_extract(t, '^([\w''-]+(?:\s[\w''-]+){2,4})', 1), 1, 60) ELSE substr(t, 1, 40) END AS title
      FROM (SELECT *, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS t FROM e))
      WHERE (contains(lower(content), 'onti') OR contains(lower(content), 'with') OR contains(lower(title), 'onti') OR contains(lower(title), 'with') OR len(list_filter(tags, lambda t: contains(lower(t), 'onti') OR contains(lower(t), 'with'))) > 0)
        AND list_has_any(tags, ['en', 'src3']) ORDER BY ts DESC, ord LIMIT 100""",
    "relevance_scores": _RELEVANT + "SELECT id, round(relevance, 4) AS relevance FROM r",
    "lexical_search": _RELEVANT + f"SELECT e.id, round(0.70::DOUBLE * relevance + 0.25::DOUBLE * ({_RECENCY}) + 0.05::DOUBLE * confidence, 4) AS score FROM e JOIN r USING (id) WHERE flag IS NULL AND user_id = 'u1' ORDER BY score DESC, ord LIMIT 10",
    "recency_decay": f"SELECT id, round({_RECENCY}, 4) AS recency FROM e",
    "filter_facets": "SELECT id, subject FROM e WHERE flag IS NULL AND user_id = 'u1' AND source IN ('technical', 'personal') AND content_type IN ('insight', 'relationship', 'procedure') AND confidence >= 0.65 AND regexp_full_match(subject, '(en|fr)\\.src[0-9]{1,2}') AND substr(subject, 7)::INT < 20",
    "hide_flagged": "SELECT id, content_type, source FROM e WHERE flag IS NULL",
    "time_range": "SELECT id, user_id FROM e WHERE flag IS NULL AND ts BETWEEN TIMESTAMP '2024-06-01' AND TIMESTAMP '2024-09-30'",
    "keyword_or": "SELECT id FROM e WHERE contains(lower(content), 'worthless') OR contains(lower(content), 'src7') OR len(list_filter(tags, lambda t: contains(lower(t), 'worthless') OR contains(lower(t), 'src7'))) > 0",
    "excerpt": "SELECT id, substr(content, 1, 300) || CASE WHEN length(content) > 300 THEN '…' ELSE '' END AS excerpt FROM e",
    "arm_term_coverage": "SELECT id, round((contains(lower(content), 'with')::INT + contains(lower(content), 'this')::INT + contains(lower(content), 'onti')::INT) / 3.0, 4)::DOUBLE AS match_score FROM e WHERE flag IS NULL ORDER BY match_score DESC, ord LIMIT 10",
    "arm_keyword": "SELECT id, confidence FROM e WHERE flag IS NULL AND (contains(lower(content), 'with') OR contains(lower(content), 'this') OR contains(lower(content), 'onti')) ORDER BY confidence DESC, ts DESC, ord LIMIT 10",
    "shards_live": "SELECT id, parent_id FROM s WHERE parent_id IS NULL OR parent_id = id OR parent_id NOT IN (SELECT id FROM e WHERE flag IS NOT NULL)",
    "vector_topk": "SELECT * FROM (SELECT a.ord AS query_id, row_number() OVER (PARTITION BY a.ord ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id)::INT AS place, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM v a, v b) WHERE place <= 10",
    "vector_topk_filtered": "SELECT * FROM (SELECT a.ord AS query_id, row_number() OVER (PARTITION BY a.ord ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id)::INT AS place, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM v a, v b JOIN e ON e.id = b.id WHERE flag IS NULL AND user_id = 'u1') WHERE place <= 5",
    "similar_pairs": "SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim >= 0.35",
    "vector_coverage": "SELECT content_type, count(*) AS expected, count(v.id) AS stored, round(count(v.id) / count(*), 4) AS coverage, CASE WHEN count(v.id) = 0 THEN 'missing' WHEN count(v.id) / count(*) < 0.8 THEN 'degraded' ELSE 'ok' END AS status FROM e LEFT JOIN v ON v.id = e.id GROUP BY content_type",
    "route_storage": "SELECT id, CASE WHEN content_type = 'procedure' OR source = 'technical' OR regexp_matches(content, '(?i)config|configuration|setting|schema|setup|installation|procedure|step.*by.*step|documentation|specification|authentication|API|endpoint|database|server|deployment|build|compile|debug|error.*log|stack.*trace') THEN 'graph,mem0,mongodb' ELSE 'graph,mem0' END AS targets FROM e",
    "suggest_relationships": "SELECT id, concat_ws(',', CASE WHEN regexp_matches(content, '(?i)\\b(fix|solution|resolved?)\\b') THEN 'SOLVES' END, CASE WHEN regexp_matches(content, '(?i)\\b(causes?|leads? to|results? in)\\b') THEN 'CAUSES' END, CASE WHEN regexp_matches(content, '(?i)\\b(requires?|depends? on|needs?)\\b') THEN 'REQUIRES' END, CASE WHEN regexp_matches(content, '(?i)\\b(similar|like|same as)\\b') THEN 'SIMILAR_TO' END, CASE WHEN regexp_matches(content, '(?i)\\b(part of|belongs? to|included? in)\\b') THEN 'PART_OF' END) AS types FROM e",
    "cache_level": "SELECT id, level, CASE level WHEN 'L1' THEN 5 WHEN 'L2' THEN 30 ELSE 60 END AS ttl_minutes FROM (SELECT id, CASE WHEN source = 'personal' THEN 'L1' WHEN content_type IN ('memory', 'insight') OR confidence > 0.8 THEN 'L2' ELSE 'L3' END AS level FROM e)",
    "supersede_chain": "SELECT o.id AS old_id, n.id AS new_id FROM e o JOIN e n ON o.superseded_by = n.id",
    "reap_candidates": "SELECT id, flag FROM e WHERE flag IS NOT NULL AND flag_date < TIMESTAMP '2025-03-01' - INTERVAL 90 DAY",
    "reap_apply": "SELECT id FROM e WHERE flag IS NULL OR flag_date >= TIMESTAMP '2025-03-01' - INTERVAL 90 DAY",
    "apply_flags": "SELECT id, CASE WHEN flag = 'RETRACTED' THEN NULL WHEN flag = 'SUPERSEDED' AND superseded_by IS NULL THEN 'UNVERIFIED' ELSE flag END AS flag, CASE WHEN flag = 'RETRACTED' THEN NULL ELSE superseded_by END AS superseded_by, strftime(CASE WHEN flag = 'RETRACTED' THEN NULL WHEN flag = 'SUPERSEDED' AND superseded_by IS NULL THEN TIMESTAMP '2025-03-01' ELSE flag_date END, '%Y-%m-%d') AS day FROM e",
    "apply_updates": "SELECT id, length(content) + CASE WHEN confidence < 0.5 THEN 10 ELSE 0 END AS chars, CASE WHEN confidence < 0.5 THEN 0.5 ELSE confidence END::DOUBLE AS confidence, CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END AS updates, strftime(CASE WHEN confidence < 0.5 THEN TIMESTAMP '2025-03-01' ELSE ts END, '%Y-%m-%d') AS day FROM e",
    "supersede_batch": "SELECT id, CASE WHEN flag = 'DELETED' THEN 'SUPERSEDED' ELSE flag END AS flag, CASE WHEN flag = 'DELETED' THEN 'n' || id ELSE superseded_by END AS superseded_by FROM e UNION ALL SELECT 'n' || id, NULL, NULL FROM e WHERE flag = 'DELETED'",
    "supersede_orphans": """, f AS (SELECT dst, arg_min(src, (-(ord // 50), ord)) AS found FROM g WHERE type = 'SUPERSEDES' AND dst IS NOT NULL GROUP BY dst), k AS (
      SELECT e.id, CASE WHEN e.superseded_by IS NULL THEN CASE WHEN found IS NOT NULL THEN 'repairable' ELSE 'true-orphan' END WHEN n.id IS NOT NULL THEN 'healthy' WHEN found IS NOT NULL THEN 'graph-only' ELSE 'dangling' END AS state, found
      FROM e LEFT JOIN e n ON n.id = e.superseded_by LEFT JOIN f ON f.dst = e.id WHERE e.flag = 'SUPERSEDED')
      SELECT id, state, CASE WHEN state = 'repairable' THEN found END AS repair_to FROM k""",
    "node_degrees": "SELECT node, count(*) AS degree FROM adj GROUP BY node",
    "detach_deleted": ", x AS (SELECT id FROM e WHERE flag = 'DELETED') SELECT type, count(*) AS n FROM u WHERE src NOT IN (SELECT id FROM x) AND dst NOT IN (SELECT id FROM x) GROUP BY type",
    "adjacency_capped": """, a AS (SELECT node, direction, type, other, min((ord, strength)) AS m FROM adj GROUP BY ALL), b AS (
      SELECT *, row_number() OVER (PARTITION BY node ORDER BY direction DESC, m[1], type, other)::INT AS place FROM a)
      SELECT node, place, direction, type, other, round(m[2] / 100, 2) AS strength, coalesce(length(substr(e.content, 1, 80)), 0) AS preview_chars FROM b LEFT JOIN e ON e.id = b.other WHERE place <= 25""",
    "bfs_two_hop": """, r AS (SELECT DISTINCT node, other FROM adj WHERE type = 'RELATED_TO'), h AS (
      SELECT node AS start, other AS node, 1 AS distance FROM r WHERE node IN (SELECT id FROM e WHERE flag IS NULL)
      UNION ALL SELECT a.node, b.other, 2 FROM r a JOIN r b ON b.node = a.other WHERE a.node IN (SELECT id FROM e WHERE flag IS NULL)), m AS (
      SELECT start, node, min(distance) AS distance FROM h WHERE node <> start GROUP BY start, node), n AS (
      SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, node)::INT AS place FROM m) SELECT * FROM n WHERE place <= 20""",
    "autolink_first5": """, n AS (SELECT a.id, b.id AS other, b.ord FROM e a JOIN e b ON a.id <> b.id AND (a.content_type = b.content_type OR a.source = b.source) WHERE a.content_type IN ('insight', 'relationship')), m AS (
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord)::INT AS place, other FROM n) SELECT * FROM m WHERE place <= 5""",
    "threshold_sweep": _PAIRS + _LEVELS + "SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM z",
    "operating_points": _PAIRS + _LEVELS + ", q AS (SELECT *, sum(fp) OVER (ORDER BY threshold DESC) AS above FROM z) SELECT (SELECT threshold FROM q ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1_threshold, min(threshold) FILTER (WHERE above = 0) AS zero_fp_threshold, max(threshold) FILTER (WHERE recall >= 0.9) AS recall_threshold FROM q",
    "similarity_histogram": _PAIRS + "SELECT least(floor((sim - 0.2::DOUBLE) / ((0.7::DOUBLE - 0.2::DOUBLE) / 20)), 19)::INT AS bin, count(*) AS n FROM p WHERE sim BETWEEN 0.2 AND 0.7 GROUP BY 1",
    "similarity_stats": _PAIRS + ", k AS (SELECT dup, list_sort(list(round(sim * 1000000)::BIGINT)) AS l, count(*) AS n FROM p GROUP BY dup) SELECT dup, n, l[1] / 1000000::DOUBLE AS min, ((20 - (n - 1) * 2 % 20) * l[(n - 1) * 2 // 20 + 1] + ((n - 1) * 2 % 20) * l[(n - 1) * 2 // 20 + 1 + CASE WHEN (n - 1) * 2 % 20 > 0 THEN 1 ELSE 0 END]) / 20000000::DOUBLE AS p10, ((20 - (n - 1) * 5 % 20) * l[(n - 1) * 5 // 20 + 1] + ((n - 1) * 5 % 20) * l[(n - 1) * 5 // 20 + 1 + CASE WHEN (n - 1) * 5 % 20 > 0 THEN 1 ELSE 0 END]) / 20000000::DOUBLE AS p25, ((20 - (n - 1) * 10 % 20) * l[(n - 1) * 10 // 20 + 1] + ((n - 1) * 10 % 20) * l[(n - 1) * 10 // 20 + 1 + CASE WHEN (n - 1) * 10 % 20 > 0 THEN 1 ELSE 0 END]) / 20000000::DOUBLE AS median, ((20 - (n - 1) * 15 % 20) * l[(n - 1) * 15 // 20 + 1] + ((n - 1) * 15 % 20) * l[(n - 1) * 15 // 20 + 1 + CASE WHEN (n - 1) * 15 % 20 > 0 THEN 1 ELSE 0 END]) / 20000000::DOUBLE AS p75, ((20 - (n - 1) * 18 % 20) * l[(n - 1) * 18 // 20 + 1] + ((n - 1) * 18 % 20) * l[(n - 1) * 18 // 20 + 1 + CASE WHEN (n - 1) * 18 % 20 > 0 THEN 1 ELSE 0 END]) / 20000000::DOUBLE AS p90, l[n] / 1000000::DOUBLE AS max, list_sum(l)::BIGINT / n::DOUBLE / 1000000::DOUBLE AS mean FROM k",
    "counts_by_type": "SELECT content_type, count(*) AS n FROM e GROUP BY content_type",
    "counts_by_source": "SELECT source, count(*) AS n FROM e GROUP BY source",
    "recent_activity": "SELECT count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-12-30') AS recent FROM e",
    "graph_density": "SELECT (SELECT count(*) FROM e) AS nodes, (SELECT count(*) FROM u) AS relationships, round((SELECT count(*) FROM u) / (SELECT count(*) FROM e), 6) AS density",
    "subject_clusters": "SELECT subject, count(*) AS n, arg_min(id, ord) AS first_id, arg_max(id, ord) AS last_id FROM e WHERE flag IS NULL GROUP BY subject HAVING count(*) >= 2",
    "cluster_reconcile": ", b AS (SELECT split_part(subject, '.', 1) AS prefix, count(*) AS entries, count(*) FILTER (WHERE flag = 'SUPERSEDED') AS superseded FROM e GROUP BY 1), n AS (SELECT split_part(e.subject, '.', 1) AS prefix, count(*) AS near FROM sims JOIN e ON e.id = a WHERE sim >= 0.35 GROUP BY 1) SELECT prefix, entries, superseded, coalesce(near, 0) AS near FROM b LEFT JOIN n USING (prefix)",
}

ORACLE_SQL = {name: TABLES + sql for name, sql in _QUERIES.items()} | {
    "chunk_h2": f"""WITH md AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), lambda x, i: CASE WHEN i % 4 = 0 THEN '## ' || x ELSE x END), chr(10) || chr(10)), chr(10)) AS l FROM documents),
      ln AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM md), hd AS (SELECT *, sum(regexp_matches(x, '^##[ \t]')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(regexp_matches(x, '^##[ \t]')::INT) OVER (PARTITION BY doc_id) AS n FROM ln),
      p AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS part FROM hd WHERE n >= 2 GROUP BY doc_id, k)
      SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk, md5({_TRIMMED.format("part")}) AS text_md5 FROM p WHERE (k > 0 OR length(part) + 1 > 200) AND {_TRIMMED.format("part")} <> ''""",
    "transcript_merge": f"""WITH sg AS (SELECT conv_id AS meeting, turn, CASE WHEN turn % 3 = 0 THEN 'system' ELSE 'microphone' END AS source, {_TRIMMED.format("text")} AS text FROM conversations WHERE turn % 7 <> 6),
      c AS (SELECT *, CASE WHEN lag(source) OVER (PARTITION BY meeting ORDER BY turn) IS NOT DISTINCT FROM source THEN 0 ELSE 1 END AS change FROM sg WHERE text <> ''), t AS (SELECT *, sum(change) OVER (PARTITION BY meeting ORDER BY turn)::BIGINT AS n FROM c)
      SELECT meeting, n AS turn, source, md5(string_agg(text, ' ' ORDER BY t.turn)) AS text_md5 FROM t GROUP BY meeting, n, source""",
    "claims_explode": """WITH f AS (SELECT conv_id AS doc, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, ['decision', 'preference', 'learning', 'context', 'brainstorm', 'reference'][(turn % 6 + 1)::INT] AS type, (turn % 3)::INT AS level FROM conversations),
      ok AS (SELECT doc FROM f WHERE r <= 5 GROUP BY doc HAVING bool_and(length(trim(text)) > 0))
      SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY level, r)::INT AS place, type, CASE WHEN type IN ('decision', 'brainstorm', 'learning') THEN 'insight' WHEN type = 'reference' THEN 'procedure' ELSE 'memory' END AS content_type,
        [0.9, 0.65, 0.4][level + 1]::DOUBLE AS confidence, length(text) AS chars FROM f WHERE r <= 5 AND doc IN (SELECT doc FROM ok)""",
    "whole_doc_type": rf"""SELECT doc_id, CASE WHEN {_word_in("spec|plan|research|design|architecture|brief|rfc")} THEN 'insight' WHEN {_word_in("meeting|standup|notes|prep|debrief|recap")} THEN 'memory'
      WHEN {_word_in("curriculum|reference|how[- ]?to|cookbook|guide|tutorial|manual|sop")} THEN 'procedure' WHEN {_word_in("tracker|status|backlog|todo|checklist")} THEN 'memory'
      WHEN regexp_matches(substr(text, 1, 200), '(?i)\A#\s+(spec|specification|implementation plan|design)') THEN 'insight' WHEN regexp_matches(lower(substr(text, 1, 500)), '\Ameeting:|\Aattendees:|## attendees') THEN 'memory' ELSE 'insight' END AS content_type FROM documents""",
    "slugify_subject": rf"""SELECT doc_id, concat_ws('.', source, {_slug("stem")}) AS subject, {_slug("lower(stem)")} AS channel, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', lang, stem)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS person
      FROM (SELECT *, regexp_replace({_NAMES}, '\.md$', '') AS stem FROM documents)""",
    "rate_limit_windows": "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL",
    "search_recommendation": """SELECT c_custkey, CASE WHEN contains(q, 'memory') OR contains(q, 'client') OR contains(q, 'behavior') THEN 'mem0,mongodb'
      WHEN contains(q, 'technique') OR contains(q, 'relationship') OR contains(q, 'effective') THEN 'graph,mem0' WHEN contains(q, 'config') OR contains(q, 'session') OR contains(q, 'setting') THEN 'mongodb,mem0' ELSE 'mem0,graph,mongodb' END AS systems
      FROM (SELECT c_custkey, lower(c_mktsegment || ' session ' || c_name) AS q FROM customer)""",
    "triggered_actions": "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'show') OR contains(lower(n_name), 'nation_1') OR contains(lower(n_name), 'nation_23')",
    "cache_stats": """WITH c AS (SELECT event_type, event_id % 3 = 0 AS l2, event_id % 7 < 4 AS hit FROM events), n AS (
      SELECT event_type, count(*) FILTER (WHERE NOT l2) AS n1, count(*) FILTER (WHERE NOT l2 AND hit) AS h1, count(*) FILTER (WHERE l2) AS n2, count(*) FILTER (WHERE l2 AND hit) AS h2 FROM c GROUP BY event_type)
      SELECT event_type, round(h1 / n1, 6) AS l1_rate, round(h2 / n2, 6) AS l2_rate, round((h1 + h2) / n1, 6) AS efficiency, round(h1 / n1 * 100 + h2 / n2 * 20, 6) AS speedup FROM n""",
    "health_rollup": "SELECT user_id, CASE WHEN count(*) FILTER (WHERE value > 50) = count(*) THEN 'error' WHEN count(*) FILTER (WHERE value > 50) > 0 THEN 'degraded' ELSE 'ok' END AS status, count(*) - count(*) FILTER (WHERE value > 50) AS healthy FROM events GROUP BY user_id",
    "quality_metrics": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS items, round(count(*) FILTER (WHERE event_id % 4 <> 0) / count(*), 6) AS on_topic_rate, round(count(*) FILTER (WHERE event_id % 3 = 0) / count(*), 6) AS usage_rate,
      round(count(*) FILTER (WHERE event_id % 11 = 0) / count(*), 6) AS contradiction_rate,
      round(CASE WHEN count(*) FILTER (WHERE event_id % 11 = 0) > 0 THEN count(*) FILTER (WHERE event_id % 22 = 0 AND event_id % 30 <= 14) / count(*) FILTER (WHERE event_id % 11 = 0) ELSE 0 END, 6) AS discovery_rate FROM events GROUP BY 1""",
    "effective_confidence": """WITH RECURSIVE d AS (SELECT 'd' || user_id AS id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_id % 3 = 0) / count(*) AS u, count(*) FILTER (WHERE event_id % 11 = 0) / count(*) AS k FROM events GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day) AS i FROM d),
      f AS (SELECT id, i, u, k FROM n WHERE i = 1 UNION ALL SELECT n.id, n.i, 0.3::DOUBLE * n.u + 0.7::DOUBLE * f.u, 0.3::DOUBLE * n.k + 0.7::DOUBLE * f.k FROM f JOIN n ON n.id = f.id AND n.i = f.i + 1)
      SELECT id, round(greatest(0, 0.8::DOUBLE * (1 + 0.5::DOUBLE * arg_max(u, i) - 2 * arg_max(k, i))), 6) AS effective FROM f GROUP BY id""",
    "sync_plan": """SELECT 'notes/' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 <> 0 AND doc_id % 13 <> 0 THEN 'skip' WHEN doc_id % 9 = 0 OR doc_id % 13 = 0 THEN 'retry' ELSE 'update' END AS action FROM documents""",
    "session_counts": "SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_used FROM events GROUP BY user_id",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "watermark_incremental": "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-05'",
    "turn_checkpoints": "SELECT conv_id, unnest(range(2, n + 1, 2)) AS checkpoint FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' AND NOT contains(text, '<command-message>') GROUP BY conv_id)",
}
