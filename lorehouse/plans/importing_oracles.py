"""DuckDB SQL of the sources' queries: what is read, straight from the tables."""

from __future__ import annotations

from .oracles import TABLES

_MEETINGS = """WITH m AS (
  SELECT doc_id AS n, CASE WHEN doc_id % 7 <> 0 THEN 'm' || doc_id ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 5 <> 0 THEN 'talk ' || doc_id ELSE '(untitled meeting)' END AS title,
    CASE WHEN doc_id % 11 = 0 THEN 'note' ELSE 'meeting' END AS type, doc_id % 13 = 0 AS deleted, TIMESTAMP '2024-01-01' + to_days((doc_id * 7919 % 400)::INT) AS day
  FROM documents WHERE doc_id % 8 <> 7
), g AS (
  SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN text ELSE '' END AS text, CASE WHEN turn // 2 % 2 = 0 THEN 'me' ELSE 'them' END AS source, CASE WHEN turn % 6 <> 5 THEN turn % 3 <> 2 ELSE true END AS final,
    CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2024-06-01 10:00:00' + to_minutes((turn % 10)::INT) END AS ended
  FROM conversations
), a AS (
  SELECT conv_id, arg_max(ended, turn) FILTER (WHERE ended IS NOT NULL) AS last FROM g GROUP BY conv_id
), v AS (
  SELECT m.*, a.conv_id IS NOT NULL AS spoken, CASE WHEN n % 4 = 0 THEN day + INTERVAL 9 HOUR WHEN n % 17 <> 0 THEN day + INTERVAL 510 MINUTE END AS start_at,
    coalesce(CASE WHEN n % 8 = 0 THEN day + INTERVAL 10 HOUR END, a.last, day + INTERVAL 12 HOUR) AS end_at
  FROM m LEFT JOIN a ON a.conv_id = m.n
)"""

#: Islands of a user's events without a gap of so many microseconds.
_ISLANDS = """WITH v AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events
), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < {gap} THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)
), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM g)"""


def _sync_runs() -> str:
    """Three runs written out: what a file was at each, and what the run before left of it."""
    steps = ["WITH l0 AS (SELECT NULL::BIGINT AS doc_id, NULL AS sha, NULL::BOOLEAN AS ok WHERE false)"]
    for run in range(3):
        sha = f"text || CASE WHEN doc_id % 10 < {run} THEN '#{run}' ELSE '' END" if run else "text"
        steps.append(
            f"""f{run} AS (SELECT d.doc_id, {sha} AS sha, l.sha AS old, l.ok FROM documents d LEFT JOIN l{run} l USING (doc_id) WHERE {run} >= d.doc_id % 4 - 1
), p{run} AS (SELECT *, CASE WHEN old IS NULL THEN 'new' WHEN sha = old AND ok THEN 'skip' WHEN NOT ok THEN 'retry' ELSE 'update' END AS action FROM f{run}
), l{run + 1} AS (SELECT doc_id, sha, (doc_id + {run}) % 7 <> 0 AS ok FROM p{run} WHERE action <> 'skip' UNION ALL SELECT * FROM l{run} WHERE doc_id NOT IN (SELECT doc_id FROM p{run} WHERE action <> 'skip'))"""
        )
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {run} AS run, action, count(*) AS n FROM p{run} GROUP BY action" for run in range(3))


ORACLE_SQL = {
    "sidecar_round_trip": TABLES + "SELECT id, sha256(content) AS content_sha, content_type, confidence, array_to_string(tags, ',') AS tags, NULL::VARCHAR AS problem FROM e UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'ends early'",
    "meeting_cache_import": _MEETINGS
    + r""", s AS (
  SELECT conv_id, turn, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM g WHERE final AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''
), c AS (
  SELECT *, CASE WHEN lag(source) OVER w IS NOT DISTINCT FROM source THEN 0 ELSE 1 END AS change FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (
  SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM c
), l AS (
  SELECT conv_id, block, source || ': ' || string_agg(text, ' ' ORDER BY turn) AS line FROM t GROUP BY conv_id, block, source
), x AS (
  SELECT conv_id, count(*) AS turns, sha256(string_agg(line, chr(10) ORDER BY block)) AS transcript_sha FROM l GROUP BY conv_id
)
SELECT id, title, strftime(start_at, '%Y-%m-%d %H:%M') AS start, strftime(end_at, '%Y-%m-%d %H:%M') AS end, turns, transcript_sha
FROM v JOIN x ON x.conv_id = v.n WHERE NOT deleted AND type = 'meeting' AND start_at IS NOT NULL AND end_at > TIMESTAMP '2024-02-20'""",
    "meeting_cache_incremental": _MEETINGS
    + r""", x AS (SELECT DISTINCT conv_id FROM g WHERE final AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''
), y AS (SELECT v.* FROM v JOIN x ON x.conv_id = v.n WHERE NOT deleted AND type = 'meeting' AND start_at IS NOT NULL AND end_at > TIMESTAMP '2024-02-20'
), ya AS (SELECT * FROM y WHERE n % 2 = 0), yb AS (SELECT * FROM y WHERE end_at > (SELECT max(end_at) FROM ya))
SELECT 0 AS run, id FROM ya UNION ALL SELECT 1, id FROM yb UNION ALL SELECT 2, strftime(max(end_at), '%Y-%m-%d %H:%M') FROM (SELECT end_at FROM ya UNION ALL SELECT end_at FROM yb)
UNION ALL SELECT 3, least(200, count(DISTINCT id))::VARCHAR FROM (SELECT id FROM ya UNION ALL SELECT id FROM yb)""",
    "meeting_cache_report": _MEETINGS + " SELECT CASE WHEN spoken THEN 'spoken' ELSE 'silent' END AS kind, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT 'problem: ends early', 1",
    "chat_dump_import": """WITH c AS (
  SELECT conv_id * 100 + turn AS n, (conv_id * 100 + turn) % 6 AS k, text FROM conversations
), p AS (
  SELECT DISTINCT 'dump-4' AS dump, 'huddle' AS problem FROM c WHERE k = 4 AND n % 10 = 0 UNION ALL SELECT 'dump-5', 'ends early'
), a AS (
  SELECT 'dump-' || k AS dump, 'C' || n % 9 AS channel_id, 'room-' || n % 9 AS channel_name, n + 1700000000 || '.000100' AS message_ts, 'T1' AS team_id, 'F' || n AS file_id,
    CASE WHEN n % 4 = 0 THEN '2024-01-01' ELSE strftime(make_timestamp((n + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS huddle_date, sha256(text) AS canvas_sha
  FROM c WHERE k % 2 = 0
), f AS (
  SELECT k, 'F' || n % 500 AS file_id, min(text) AS text FROM c WHERE k % 2 = 1 AND n % 500 % 2 = 0 GROUP BY k, n % 500
), b AS (
  SELECT 'dump-' || c.k, 'C' || n % 9, 'side', n + 1700000000 || '.000100', 'T2', f.file_id, strftime(make_timestamp((n + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z', sha256(f.text)
  FROM c JOIN f ON f.k = c.k AND f.file_id = 'F' || n % 500 WHERE n % 3 <> 2 AND (n % 4 = 1 OR n % 5 = 0)
)
SELECT *, NULL::VARCHAR AS problem FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE dump NOT IN (SELECT dump FROM p)
UNION ALL SELECT dump, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem FROM p""",
    "markdown_import": r"""SELECT project || '/' || CASE WHEN item_id % 6 = 2 THEN 'deep/er/' ELSE '' END || item_id || '.md' AS path, project, strlen(content)::BIGINT AS size, sha256(content) AS sha256, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''))::BIGINT AS words
FROM (SELECT item_id, ['notes', 'plans', 'flat'][(item_id % 3)::INT + 1] AS project, '# ' || item_id || chr(10) || text AS content FROM benchmark)
WHERE item_id % 10 <> 9 AND item_id % 6 NOT IN (0, 1) AND NOT (project = 'flat' AND item_id % 6 = 2)""",
    "backfill_resumed": TABLES + """, w AS (SELECT id, len(regexp_extract_all(lower(content), '[a-z0-9]+'))::DOUBLE AS n, length(content) % 10 AS k, ord FROM e
), x AS (SELECT *, ord % 3 <> 0 AS asked, ord % 3 <> 0 AND k <> 3 AND n > 0 AS filled FROM w)
SELECT id, CASE WHEN filled THEN 'hashed-8' WHEN ord % 3 = 0 THEN 'older' WHEN ord % 3 = 1 THEN '' END AS embedder_id, CASE WHEN filled THEN n END AS words, filled, filled::BIGINT AS written, CASE WHEN asked AND NOT filled THEN 'no vector' END AS error FROM x""",
    # a batch is held against the watermark that the batch before it ran with: of all parts before that one
    "late_events": """WITH x AS (SELECT event_id % 4 AS part, ts FROM events WHERE event_id % 4 <> 3 OR day(ts) <= 10
), t AS (SELECT part, max(ts) AS top FROM x GROUP BY part
), m AS (SELECT a.part, max(date_trunc('millisecond', b.top)) - INTERVAL 2 DAY AS mark FROM t a LEFT JOIN t b ON b.part <= a.part - 2 GROUP BY a.part
), k AS (SELECT coalesce(x.ts <= m.mark, false) AS late FROM x JOIN m ON m.part = x.part)
SELECT 'kept' AS kind, count(*) FILTER (WHERE NOT late) AS n FROM k UNION ALL SELECT 'late', count(*) FILTER (WHERE late) FROM k""",
    "closed_sessions": _ISLANDS.format(gap=6 * 3_600_000_000) + " SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, island HAVING max(t) + 21600000000 <= (SELECT max(t) // 1000 * 1000 - 172800000000 FROM v)",
    "session_marks": _ISLANDS.format(gap=86_400_000_000) + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY t, event_id) AS mark FROM i) SELECT user_id, mark, t AS at_us FROM r WHERE mark % 3 = 0",
    "distilled": TABLES + """, t AS (SELECT id, length(content) AS n FROM e), x AS (
  SELECT id, n, CASE WHEN n % 4 = 3 AND n % 8 = 3 THEN 'not JSON' WHEN n % 7 = 0 THEN 'no claims' WHEN n % 11 = 3 THEN 'claim 0' END AS error FROM t
)
SELECT id, NULL::INT AS place, NULL AS type, NULL AS content, NULL::DOUBLE AS confidence, NULL AS topics, error FROM x WHERE error IS NOT NULL
UNION ALL SELECT id, 0, 'summary', 'text of ' || n, NULL, NULL, NULL FROM x WHERE error IS NULL
UNION ALL SELECT id, (i + 1)::INT, ['decision', 'preference', 'learning', 'context', 'brainstorm', 'reference'][(n + i) % 6 + 1], 'claim ' || i || ' of ' || n, [0.9, 0.65, 0.4][(n + i) % 3 + 1]::DOUBLE, 't' || i, NULL
FROM x, range(5) r(i) WHERE error IS NULL AND i < n % 7""",
    "sync_log_runs": _sync_runs(),
    "graph_migration": """SELECT CASE WHEN n % 4 <> 0 THEN 'part-' || n ELSE '4:p:' || n END AS id,
  coalesce(nullif(concat_ws(' — ', CASE WHEN n % 3 <> 0 THEN p_name END, CASE WHEN n % 5 <> 0 THEN p_brand END), ''), CASE WHEN n % 4 <> 0 THEN 'part-' || n ELSE '4:p:' || n END) AS content,
  CASE WHEN n % 7 = 0 THEN 'procedure' WHEN n % 9 = 0 THEN 'fact' ELSE 'Part' END AS content_type, 'graph-import' AS source, CASE WHEN n % 2 = 0 THEN round((n % 10) / 10.0::DOUBLE, 4) ELSE 0.8::DOUBLE END AS confidence,
  CASE WHEN n % 6 = 0 THEN '2024-03-01 10:00' ELSE '2025-03-01 00:00' END AS ts, 'long=5000;notes=' || CASE WHEN n % 5 = 0 THEN '  ' ELSE p_brand END || ';tag_list=[' || n % 3 || ',' || n % 5 || ']' AS metadata
FROM (SELECT *, p_partkey AS n FROM part) WHERE n % 50 <> 0
UNION ALL SELECT '4:s:' || s_suppkey, s_name, 'Organization', 'graph-import', 0.8, '2025-03-01 00:00', 'rank=' || s_suppkey FROM supplier""",
    "graph_migration_edges": """SELECT CASE WHEN p_partkey % 4 <> 0 THEN 'part-' || p_partkey ELSE '4:p:' || p_partkey END AS src, 'SOLD_BY_' || upper(l_returnflag) AS type,
  CASE WHEN p_partkey IS NULL OR s_suppkey IS NULL THEN 'no-end' ELSE 'ok' END AS status, count(*) AS n, count(DISTINCT s_suppkey) AS ends
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 50 <> 0 LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""",
}
