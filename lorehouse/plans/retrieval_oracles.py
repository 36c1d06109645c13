"""DuckDB SQL of the vector index's queries, what an exact search finds, and of those on entities."""

from __future__ import annotations

from .oracles import ORACLE_SQL as KNOWN
from .oracles import TABLES

_LABELS = "['Knowledge', 'Person', 'Organization', 'Project', 'Technology', 'Concept', 'Service', 'Event', 'ContextTrigger', 'ToolRoute']"
_NODES = f""", n AS (
  SELECT 'd' || doc_id AS id, {_LABELS}[(doc_id % 10)::INT + 1] AS label FROM documents WHERE doc_id % 7 <> 3
  UNION ALL SELECT 'd' || doc_id, {_LABELS}[((doc_id + 4) % 10)::INT + 1] FROM documents WHERE doc_id % 5 = 1
  UNION ALL SELECT 'x' || doc_id, 'Person' FROM documents WHERE doc_id % 50 = 0
)"""
_STEPS = """, st AS (
  SELECT node, other, min((CASE WHEN direction = 'in' THEN 1 ELSE 0 END) * 1000000000 + ord) AS pos, arg_min(strength, (CASE WHEN direction = 'in' THEN 1 ELSE 0 END) * 1000000000 + ord) AS strength
  FROM adj WHERE type = 'RELATED_TO' GROUP BY node, other
)"""

ORACLE_SQL = {name: KNOWN["vector_topk"] for name in ("vector_index_exact", "vector_index_grown")} | {
    "related_paths": TABLES.replace("WITH e AS", "WITH RECURSIVE e AS")
    + _STEPS
    + """, w AS (
  SELECT id AS start, id AS node, 0 AS distance, NULL::VARCHAR AS parent, NULL::BIGINT AS pos, NULL::BIGINT AS strength FROM e WHERE flag IS NULL
  UNION ALL
  SELECT w.start, st.other, w.distance + 1, w.node, st.pos, st.strength FROM w JOIN st ON st.node = w.node WHERE w.distance < 2
), f AS (
  SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY distance, pos, strength, parent) AS r FROM w
), p AS (
  SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, pos, node) AS place FROM f WHERE r = 1 AND distance > 0
)
SELECT start, node, distance, parent, round(least(1, greatest(0, strength / 100.0::DOUBLE)), 4) AS strength, place FROM p WHERE place <= 20""",
    "entity_summaries": TABLES
    + _NODES
    + _STEPS
    + """, i AS (
  SELECT DISTINCT CASE WHEN doc_id % 25 = 0 THEN 'x' ELSE 'd' END || doc_id AS id FROM documents
), t AS (
  SELECT id, arg_min(label, list_position(['Knowledge', 'Person', 'Organization', 'Project', 'Technology', 'Concept', 'Service', 'Event'], label)) AS type FROM n WHERE label NOT IN ('ContextTrigger', 'ToolRoute') GROUP BY id
), o AS (
  SELECT node, other, min(ord) AS ord FROM adj WHERE type = 'RELATED_TO' GROUP BY node, other
), k AS (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY ord, other) AS r FROM o
), y AS (
  SELECT k.node AS id, string_agg(e.id || '=' || length(e.content[:40]), ',' ORDER BY r) AS related FROM k JOIN e ON e.id = k.other WHERE r <= 4 GROUP BY k.node
)
SELECT i.id, CASE WHEN t.type IS NOT NULL THEN array_to_string(string_split(e.content, ' ')[:3], ' ') END AS name, coalesce(t.type, 'Knowledge') AS type, sha256(e.content[:200]) AS summary_sha, CASE WHEN t.type IS NOT NULL THEN coalesce(y.related, '') ELSE '' END AS related
FROM i LEFT JOIN t ON t.id = i.id LEFT JOIN e ON e.id = i.id LEFT JOIN y ON y.id = i.id WHERE t.type IS NOT NULL OR e.id IS NOT NULL""",
    "entity_cards": TABLES
    + _NODES
    + """, l AS (
  SELECT id, list(DISTINCT label) AS labels FROM n GROUP BY id
), h AS (
  SELECT item_id AS query_id, ['graph', 'mongodb', 'mem0'][j % 3 + 1] AS arm, j % 3 AS a, j // 3 AS place, e.id, coalesce(l.labels, []) AS labels, CASE WHEN e.ord % 3 <> 0 THEN ['d' || e.ord * 7 % 40, 'd' || e.ord * 3 % 20] ELSE [] END AS refs
  FROM benchmark, range(9) t(j) JOIN e ON e.ord = (item_id * 13 + j * 11) % 150 LEFT JOIN l ON l.id = e.id
), a AS (
  SELECT query_id, id, place * 10 AS pos FROM h WHERE arm = 'graph' AND list_has_any(labels, ['Person', 'Organization', 'Project', 'Technology', 'Concept', 'Service', 'Event']) AND NOT list_has_any(labels, ['ContextTrigger', 'ToolRoute'])
  UNION ALL SELECT query_id, refs[1], a * 1000 + place * 10 FROM h WHERE arm <> 'graph' AND len(refs) > 0
  UNION ALL SELECT query_id, refs[2], a * 1000 + place * 10 + 1 FROM h WHERE arm <> 'graph' AND len(refs) > 0
), c AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY min(pos), id) AS place FROM a GROUP BY query_id, id QUALIFY place <= 6
), m AS (
  SELECT h.query_id, h.arm || h.place AS what, h.id, list_filter(list_prepend(h.id, h.refs), lambda r: list_contains(c.ids, r)) AS linked FROM h LEFT JOIN (SELECT query_id, list(id) AS ids FROM c GROUP BY query_id) c ON c.query_id = h.query_id
)
SELECT query_id, what, id, coalesce(array_to_string(linked, ','), '') AS linked FROM m UNION ALL SELECT query_id, 'entity' || place, id, '' FROM c""",
    "model_links": KNOWN["entity_links"].rsplit("SELECT id, entity FROM el", 1)[0]
    + """SELECT id, entity, 'mention' AS how FROM el WHERE id NOT IN (SELECT 'd' || doc_id FROM documents WHERE doc_id % 6 = 0 AND doc_id % 40 IN (SELECT item_id FROM benchmark))
UNION ALL SELECT 'd' || doc_id, doc_id % 40, 'model' FROM documents WHERE doc_id % 6 = 0 AND doc_id % 40 IN (SELECT item_id FROM benchmark)""",
    "default_bands": TABLES
    + """, x AS (SELECT v.id, round(0.75 + abs(vec[1]), 6) AS sim, CASE content_type WHEN 'procedure' THEN 0.85 WHEN 'pattern' THEN 0.92 ELSE 0.88 END AS r FROM v JOIN e ON e.id = v.id)
SELECT id, CASE WHEN sim >= r THEN 'refuse' WHEN sim >= 0.78 THEN 'confirm' ELSE 'pass' END AS plain, CASE WHEN sim >= 0.9 THEN 'refuse' WHEN sim >= 0.8 THEN 'confirm' ELSE 'pass' END AS override,
  CASE WHEN sim >= r THEN 'refuse' WHEN sim >= 0.78 THEN 'confirm' ELSE 'pass' END AS half, CASE WHEN sim >= r THEN 'refuse' WHEN sim >= 0.78 THEN 'confirm' ELSE 'pass' END AS crossed FROM x""",
    "claim_types": "SELECT conv_id, turn, ['insight', 'memory', 'insight', 'memory', 'insight', 'procedure', 'memory'][((conv_id + turn) % 7)::INT + 1] AS as_insight, ['insight', 'memory', 'fact', 'memory', 'insight', 'procedure', 'memory'][((conv_id + turn) % 7)::INT + 1] AS as_fact FROM conversations",
    "neighbour_cosines": TABLES + "SELECT a.ord, CASE WHEN a.ord % 50 = 7 OR b.ord % 50 = 7 THEN 0.0::DOUBLE ELSE round(list_cosine_similarity(a.vec, b.vec), 6) END AS sim FROM v a JOIN v b ON b.ord = a.ord + 1",
    "calibration_round_trip": TABLES + "SELECT a.id AS id_a, b.id AS id_b, round((a.ord % 100) / 100.0::DOUBLE, 2) AS sim_observed, CASE a.ord % 3 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'distinct' END AS human_label, sha256(a.content[:80] || '|' || b.content[:80]) AS sha, NULL::VARCHAR AS _problem FROM e a JOIN e b ON b.ord = a.ord + 1",
    "meeting_dump_import": """WITH m AS (SELECT conv_id AS n, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT 'm' || n AS id, 'talk ' || n AS title, CASE WHEN n % 2 = 0 THEN '2024-05-01' END AS date, sha256(t) AS sha, NULL::VARCHAR AS problem FROM m WHERE n % 5 < 3
UNION ALL VALUES (NULL, NULL, NULL, NULL, 'meeting'), (NULL, NULL, NULL, NULL, 'not an array')""",
    "document_pages": TABLES + """, f AS (SELECT id, row_number() OVER (ORDER BY ts DESC, ord) AS r FROM e WHERE contains(lower(content), 'er') OR list_bool_or(list_transform(tags, lambda t: contains(lower(t), 'er')))) SELECT 0 AS asked, id FROM f WHERE r <= 1 UNION ALL SELECT 7, id FROM f WHERE r <= 7 UNION ALL SELECT 250, id FROM f WHERE r <= 100""",
}
