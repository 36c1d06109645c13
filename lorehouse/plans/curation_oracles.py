"""DuckDB SQL of the curation queries."""

from .oracles import _BY_CONTENT, _INFERRED, _QUERIES, TABLES

_PAIRS = """, tp AS (SELECT a, b, round(sim, 6) AS sim, x.ord AS ord_a, y.ord AS ord_b, x.content_type AS type_a, y.content_type AS type_b, x.source AS source_a, y.source AS source_b, x.subject AS subject_a, y.subject AS subject_b, x.content AS content_a, y.content AS content_b
  FROM sims JOIN e x ON x.id = a JOIN e y ON y.id = b WHERE sim >= 0.35)"""
_QUANTILES = ", ".join(f"((20 - (n - 1) * {q} % 20) * l[(n - 1) * {q} // 20 + 1] + ((n - 1) * {q} % 20) * l[(n - 1) * {q} // 20 + 1 + CASE WHEN (n - 1) * {q} % 20 > 0 THEN 1 ELSE 0 END]) / 20000000::DOUBLE AS {x}" for x, q in (("p10", 2), ("p25", 5), ("median", 10), ("p75", 15), ("p90", 18)))
_MEETINGS = r"""WITH dc AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 5 = 1 THEN 'note' WHEN conv_id % 5 = 2 THEN 'meeting' END AS type, conv_id % 11 = 0 AS gone, CASE WHEN conv_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((conv_id * 37 % 200)::INT) END AS created_at FROM conversations
), tr AS (SELECT conv_id AS id, max(TIMESTAMP '2024-01-01' + to_days((conv_id * 37 % 200)::INT) + to_hours(turn)) AS end_ts, count(*) AS segments FROM conversations WHERE conv_id % 13 <> 0 AND length(trim(text)) > 0 AND turn % 7 <> 6 GROUP BY conv_id
)"""
_STATE = "CASE WHEN gone THEN 'deleted' WHEN type IS NOT NULL AND type <> 'meeting' THEN 'other-type' WHEN created_at IS NULL THEN 'no-start' WHEN end_ts IS NULL THEN 'no-transcript' WHEN end_ts <= TIMESTAMP '2024-02-20' THEN 'late' ELSE 'ready' END"
_WORDS = "['ash', 'birch', 'cedar', 'elm', 'fir', 'hazel', 'larch', 'maple', 'oak', 'pine', 'rowan', 'yew']"

_BANDS = _QUERIES["gate_bands"].partition("SELECT id, candidate")[0]

_ENTRIES = {
    "jsonl_round_trip": """SELECT 'manifest' AS kind, 'manifest' AS status, 1::BIGINT AS n, NULL::BIGINT AS strength, NULL::BIGINT AS chars
      UNION ALL SELECT 'node', CASE WHEN content_type IN ('memory', 'insight', 'fact', 'procedure') THEN 'ok' ELSE 'label-refused' END AS st, count(*), NULL, sum(length(content))::BIGINT FROM e GROUP BY st
      UNION ALL SELECT 'edge', CASE WHEN type IN ('RELATED_TO', 'ABOUT', 'SOLVES') THEN 'ok' ELSE 'relation-refused' END AS st, count(*), sum(strength)::BIGINT, NULL FROM u GROUP BY st""",
    "documents_insert_or_get": r""", h AS (SELECT id, ord, flag, lower(regexp_replace(content, '\A[\s\x{A0}]+|[\s\x{A0}]+\z', '', 'g')) AS h FROM e), k AS (SELECT h, arg_min(id, ord) AS known FROM h WHERE flag IS NOT NULL GROUP BY h), f AS (SELECT h, arg_min(id, ord) AS first FROM h WHERE flag IS NULL GROUP BY h)
      SELECT id, coalesce(known, first) AS stored_id, known IS NULL AND id = first AS is_new FROM h JOIN f USING (h) LEFT JOIN k USING (h) WHERE flag IS NULL""",
    "relation_types": "SELECT DISTINCT type FROM u",
    "entity_candidates": "SELECT id, content_type AS label, place FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY ord)::INT AS place, list_position(['insight', 'fact', 'memory'], content_type) AS k FROM e WHERE content_type IN ('insight', 'fact', 'memory')) WHERE place <= 100 ORDER BY k, place LIMIT 250",
    "edges_resolved": ", k AS (SELECT id FROM e WHERE flag IS DISTINCT FROM 'DELETED') SELECT type, coalesce(src IN (SELECT id FROM k), false) AND coalesce(dst IN (SELECT id FROM k), false) AS found, count(*) AS n FROM g GROUP BY ALL",
    "presence_probe": "SELECT id, id IN (SELECT dst FROM u WHERE type = 'SOLVES') AS in_graph, source = 'technical' AS in_documents FROM e",
    "shards_page": "SELECT id, score::DOUBLE AS score FROM s WHERE id > 'm_1' ORDER BY id LIMIT 50",
    "shard_by_entry": "SELECT parent_id, min(id) AS shard, count(*) AS n FROM s WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "candidates_by_backend": "SELECT id, string_agg(backend, ',' ORDER BY backend) AS backends FROM (SELECT id, 'graph' AS backend FROM e WHERE ord % 2 = 0 UNION ALL SELECT id, 'documents' FROM e WHERE ord % 3 = 0 UNION ALL SELECT id, 'shards' FROM e WHERE ord % 5 = 0) GROUP BY id",
    "vector_hits_hydrated": """, nr AS (SELECT a.ord AS query_id, b.id, row_number() OVER (PARTITION BY a.ord ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id)::INT AS place FROM v a, v b WHERE a.label = 0)
      SELECT query_id, place, nr.id, length(coalesce(e.content, 'vector ' || nr.id)) AS chars, coalesce(confidence, 0)::DOUBLE AS confidence FROM nr LEFT JOIN e ON e.id = nr.id AND e.flag IS NULL WHERE place <= 3""",
    "merge_refs": """SELECT id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS refs, CASE WHEN ord % 4 = 0 THEN 'r' || (ord % 7) WHEN ord % 3 = 0 THEN 'r9,r' || (ord % 2) END AS relationships,
      concat_ws(',', CASE WHEN ord % 2 = 0 THEN 'graph' END, CASE WHEN ord % 3 = 0 THEN 'documents' END) AS systems
      FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN ['e' || (ord % 5), 'e' || (ord % 3)] ELSE [] END || CASE WHEN ord % 3 = 0 THEN ['e' || (ord % 4)] ELSE [] END AS r FROM e WHERE ord % 2 = 0 OR ord % 3 = 0)""",
    "linked_entities": "SELECT id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS linked FROM (SELECT id, CASE WHEN ord < 6 THEN [id] ELSE [] END || list_filter(['d' || (ord % 10), 'd' || (ord % 7)], lambda x: x IN ('d0', 'd1', 'd2', 'd3', 'd4', 'd5')) AS r FROM e)",
    "judge_decisions": _BANDS
    + """SELECT id, candidate, band, CASE WHEN band = 'refuse' THEN 'duplicate' WHEN (x + y) % 3 <> 0 THEN ['supersedes', 'duplicate', 'complement', 'supersedes-reverse', 'unrelated'][((x + y) % 5 + 1)::INT] END AS relation
      FROM (SELECT *, substr(id, 2)::BIGINT AS x, substr(candidate, 2)::BIGINT AS y, CASE WHEN sim >= 0.45 THEN 'refuse' ELSE 'confirm' END AS band FROM pt WHERE place <= 5)""",
    "action_errors": """SELECT id, CASE WHEN right(id, 1) = '7' THEN NULL WHEN k IN (0, 1) AND (ord % 3 = 0 OR ord % 4 = 0) THEN ['supersede', 'update'][k + 1] || ' needs target_id and reason' WHEN k = 2 AND ord % 3 = 0 THEN 'complement needs target_id' WHEN k = 3 AND ord % 4 = 0 THEN 'force-new needs reason' WHEN k = 4 THEN 'unknown action merge' END AS error FROM (SELECT *, (ord % 5)::INT AS k FROM e)""",
    "orphans_repaired": ", f AS (SELECT dst, arg_min(src, (-(ord // 50), ord)) AS found FROM g WHERE type = 'SUPERSEDES' AND dst IS NOT NULL GROUP BY dst) SELECT id, flag, CASE WHEN flag = 'SUPERSEDED' THEN coalesce(superseded_by, found) END AS superseded_by FROM e LEFT JOIN f ON dst = id",
    "auto_flagged": "SELECT CASE WHEN flag IS NULL AND ord % 9 = 0 AND ord % 2 <> 0 AND TIMESTAMP '2025-01-20' + to_days((ord % 60)::INT) < TIMESTAMP '2025-02-15' AND ord IN (SELECT event_id FROM events) THEN 'UNVERIFIED' ELSE flag END AS flag, count(*) AS n FROM e GROUP BY 1",
    "retried_as_updates": _BY_CONTENT
    + """, fd AS (SELECT norm, user_id, content_type, subject, arg_min(id, ord) AS first_id FROM bc WHERE flag IS NULL GROUP BY ALL), rf AS (
      SELECT bc.id, ord, first_id FROM bc JOIN fd ON bc.norm = fd.norm AND bc.user_id = fd.user_id AND bc.content_type = fd.content_type AND bc.subject IS NOT DISTINCT FROM fd.subject WHERE flag IS NULL AND id <> first_id)
      SELECT first_id AS id, count(*)::INT AS updates, 'merged from ' || arg_max(rf.id, rf.ord) AS last, arg_max(confidence, rf.ord) AS confidence FROM rf JOIN e ON e.id = rf.id GROUP BY first_id""",
    "stats_by_type": _PAIRS + ", k AS (SELECT content_type, list_sort(list(round(sim * 1000000)::BIGINT)) AS l, count(*) AS n FROM (SELECT sim, unnest(list_distinct([type_a, type_b])) AS content_type FROM tp) GROUP BY content_type) SELECT content_type, n, l[1] / 1000000::DOUBLE AS min, " + _QUANTILES + ", l[n] / 1000000::DOUBLE AS max, list_sum(l)::BIGINT / n::DOUBLE / 1000000::DOUBLE AS mean FROM k",
    "stats_by_provenance": _PAIRS + "SELECT least(source_a, source_b) || '-' || greatest(source_a, source_b) AS provenance, count(*) AS n, count(*) FILTER (WHERE sim >= 0.45) AS high, count(*) FILTER (WHERE sim < 0.4) AS low FROM tp GROUP BY 1",
    "pair_sample": _PAIRS + "SELECT a, b, sim FROM tp ORDER BY md5(a || '|' || b), a, b LIMIT 80",
    "auto_labels": _PAIRS
    + r""", ln AS (SELECT a, b, sim, source_a = source_b AS same, length(trim(regexp_replace(lower(content_a), '\s+', ' ', 'g'))) AS x, length(trim(regexp_replace(lower(content_b), '\s+', ' ', 'g'))) AS y FROM tp),
      lb AS (SELECT a, b, sim, CASE WHEN sim >= 0.4 AND same AND (CASE WHEN greatest(x, y) = 0 THEN 1 ELSE least(x, y) / greatest(x, y) END) > 0.5 THEN 'duplicate' WHEN sim >= 0.35 AND sim < 0.37 THEN 'look-at' END AS label FROM ln)
      SELECT a, b, label, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, a, b)::INT AS place FROM lb WHERE label IS NOT NULL) WHERE place <= 25""",
    "pairs_relabelled": _PAIRS + "SELECT a, b, CASE WHEN (ord_a + ord_b) % 3 = 0 THEN 'looked-at' WHEN sim >= 0.45 THEN 'duplicate' ELSE 'distinct' END AS label FROM tp",
    "routes_with_model": f"""SELECT id, CASE WHEN ord % 10 >= 6 THEN CASE WHEN ord % 5 <> 0 AND ord % 3 = 0 THEN 'graph,mem0,mongodb' ELSE 'graph,mem0' END ELSE targets END AS targets FROM e JOIN ({_QUERIES["route_storage"]}) USING (id)""",
    "metadata_tags": _INFERRED + "SELECT i4.id, array_to_string(list_filter(e.tags, lambda x: x IS NOT NULL) || list_filter(i4.tags, lambda x, i: list_position(i4.tags, x) = i), ',') AS tags, i4.content_type, ((project IS NOT NULL)::INT + (language IS NOT NULL)::INT + len(frameworks))::INT AS hints FROM i4 JOIN e ON e.id = i4.id",
    "legacy_relevance": "SELECT id, round((contains(c, 'with')::INT + contains(c, 'this')::INT + contains(c, 'onti')::INT) * CASE WHEN contains(c, 'with this onti') THEN 1.5::DOUBLE ELSE 1 END / 3, 6)::DOUBLE AS relevance FROM (SELECT id, lower(content) AS c FROM e)",
    "hash_keys": "SELECT id, substr(sha256(id || chr(0) || user_id), 1, 32) AS cache_key, sha256(id || '|' || source) AS judge_key FROM e",
    "embedding_backfill": """, w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS w FROM e WHERE ord % 3 <> 0 AND ord % 4 <> 0), b AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 8 AS b FROM w),
      k AS (SELECT id, count(*)::DOUBLE AS words, count(*) FILTER (WHERE b = 0)::DOUBLE AS v0, count(*) FILTER (WHERE b = 1)::DOUBLE AS v1, count(*) FILTER (WHERE b = 2)::DOUBLE AS v2 FROM b GROUP BY id)
      SELECT e.id, words, v0, v1, v2 FROM e LEFT JOIN k ON k.id = e.id WHERE ord % 3 <> 0 AND ord % 4 <> 0""",
    "enrichment_batches": "SELECT batch, id FROM (SELECT id, strftime(ts, '%Y-%m') AS batch, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ord DESC) AS r FROM e) WHERE r <= 50",
}

ORACLE_SQL = {name: TABLES + sql for name, sql in _ENTRIES.items()} | {
    "node_contents": """SELECT 'p' || p_partkey AS id, coalesce(nullif(concat_ws(' — ', nullif(trim(CASE WHEN p_partkey % 3 <> 0 THEN p_name END), ''), nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN '  ' WHEN p_partkey % 9 <> 0 THEN p_brand END), '')), ''), 'p' || p_partkey) AS content FROM part""",
    "people_resolved": f"""WITH p AS (SELECT s_suppkey AS n, {_WORDS}[(s_suppkey % 12 + 1)::INT] AS f, {_WORDS}[(s_suppkey // 12 % 12 + 1)::INT] AS l, 'p' || lpad(s_suppkey::VARCHAR, 6, '0') AS person FROM supplier
), m AS (SELECT DISTINCT CASE n % 5 WHEN 0 THEN upper(f || ' ' || l[1] || '. ' || l) || '!' WHEN 1 THEN upper(f[1]) || f[2:] || ' ' || upper(l[1]) || l[2:] WHEN 2 THEN f || '_' || n WHEN 3 THEN '#' || n ELSE l END AS mention,
  CASE n % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'ends' WHEN 2 THEN 'exact' ELSE 'part' END AS how, CASE n % 5 WHEN 3 THEN n::VARCHAR WHEN 4 THEN l END AS needle, CASE WHEN n % 5 = 2 THEN person END AS own, CASE WHEN n % 5 < 2 THEN f END AS f, CASE WHEN n % 5 IN (0, 1, 4) THEN l END AS l FROM p
), k AS (SELECT f, l, min(person) AS person FROM p GROUP BY f, l), o AS (SELECT needle, count(DISTINCT person) AS c, min(person) AS person FROM (SELECT DISTINCT needle FROM m WHERE how = 'part') JOIN (SELECT person, f || ' ' || l[1] || '. ' || l AS t FROM p UNION ALL SELECT person, f || '_' || n FROM p) ON contains(t, needle) GROUP BY needle)
SELECT mention, coalesce(own, k.person, o.person) AS person, how FROM m LEFT JOIN k ON k.f = m.f AND k.l = m.l LEFT JOIN o ON m.how = 'part' AND o.needle = m.needle AND o.c = 1 WHERE coalesce(own, k.person, o.person) IS NOT NULL""",
    "meeting_import": _MEETINGS + " SELECT id, segments, strftime(end_ts, '%Y-%m-%d %H') AS end_hour FROM dc JOIN tr USING (id) WHERE NOT gone AND (type IS NULL OR type = 'meeting') AND created_at IS NOT NULL AND end_ts > TIMESTAMP '2024-02-20'",
    "meeting_import_report": _MEETINGS + f" SELECT {_STATE} AS status, count(*) AS n, strftime(max(end_ts), '%Y-%m-%d %H') AS last_hour FROM dc LEFT JOIN tr USING (id) GROUP BY 1",
    "huddle_canvases": "SELECT conv_id, turn, 'T' || (n % 9) AS team, 'F' || (n % 50) AS file_id, length(d.text) AS chars FROM (SELECT conv_id, turn, conv_id * 100 + turn AS n FROM conversations) JOIN documents d ON d.doc_id = n % 50 WHERE n % 3 <> 0 AND (n % 2 = 0 OR n % 5 = 0)",
    "files_changed": """SELECT ['notes', 'plans', 'private', 'archive'][(doc_id % 4 + 1)::INT] || CASE WHEN doc_id % 6 = 2 THEN '/deep/' ELSE '/' END || doc_id || '.md' AS path, strftime(TIMESTAMP '2024-01-01' + to_days((doc_id * 7919 % 400)::INT), '%Y-%m-%d') AS day
      FROM documents WHERE doc_id % 4 < 2 AND doc_id % 6 NOT IN (0, 1) AND doc_id % 10 <> 9 AND doc_id * 7919 % 400 > 60""",
    "sync_report": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 <> 0 AND doc_id % 13 <> 0 THEN 'skip' WHEN doc_id % 9 = 0 OR doc_id % 13 = 0 THEN 'retry' ELSE 'update' END AS action, count(*) AS n FROM documents GROUP BY 1",
    "last_five_events": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5",
    "sessions_kept": "SELECT user_id || '-' || event_type AS session_id, count(*) AS requests FROM events GROUP BY user_id, event_type HAVING max(ts) >= TIMESTAMP '2024-01-24'",
    "sessions_by_service": "SELECT event_type AS service, count(DISTINCT user_id) AS sessions, count(*) AS requests FROM events GROUP BY event_type",
    "systems_healthy": "SELECT count(*) AS systems, count(*) FILTER (WHERE ok) AS healthy, round((sum(h1) + sum(h2)) / sum(n1), 6) AS cache_efficiency FROM (SELECT count(*) FILTER (WHERE value <= 50) / count(*) > 0.5 AS ok, count(*) FILTER (WHERE event_id % 3 <> 0 AND event_id % 7 < 4) AS h1, count(*) FILTER (WHERE event_id % 3 = 0 AND event_id % 7 < 4) AS h2, count(*) FILTER (WHERE event_id % 3 <> 0) AS n1 FROM events GROUP BY event_type)",
    "rule_columns": """SELECT doc_id, ['duplicate', 'supersedes-reverse', 'contradicts', 'unrelated', 'complement'][(doc_id % 5 + 1)::INT] AS relation, ['lost-update', 'sidecar-orphan', 'unclassified', 'lost-update'][(doc_id % 4 + 1)::INT] AS error,
      CASE WHEN doc_id % 3 = 0 THEN '10.0.0.' || (doc_id % 200) WHEN doc_id % 2 = 0 THEN '172.16.0.1' ELSE 'unknown' END AS client, CASE WHEN doc_id % 130 BETWEEN 10 AND 110 THEN doc_id % 130 - 10 END::INT AS encoded,
      round(greatest(0, least(1, doc_id % 130 / 100.0::DOUBLE - 0.1::DOUBLE)), 6)::DOUBLE AS decoded, 'DEPENDS_ON_' || (doc_id % 7) AS name, doc_id % 9 = 3 AS hit, CASE doc_id % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.3 ELSE 0.6 END::DOUBLE AS confidence FROM documents""",
    "operational_actions": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ',go' ELSE '' END AS actions FROM events",
    "event_times": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN strftime(TIMESTAMP '1970-01-01' + to_days(event_id::INT), '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN '2020-01-01 00:00:00' ELSE '2024-02-03 04:05:06' END AS at FROM events",
    "ttl_cache_hits": """WITH RECURSIVE o AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT key, i, t AS filled, false AS hit FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, CASE WHEN o.t < r.filled + 3600000000 THEN r.filled ELSE o.t END, o.t < r.filled + 3600000000 FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
      SELECT key, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS fills FROM r GROUP BY key""",
    "watermark_report": """WITH x AS (SELECT event_id % 4 AS part, ts FROM events WHERE event_id % 4 <> 3 OR day(ts) <= 10), t AS (SELECT part, max(ts) AS top FROM x GROUP BY part), m AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM t)
      SELECT part, count(*) AS n, count(*) FILTER (WHERE ts < mark) AS late FROM x JOIN m USING (part) GROUP BY part""",
}
