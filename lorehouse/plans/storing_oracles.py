"""DuckDB SQL of the store's queries."""

from __future__ import annotations

from .oracles import TABLES

ORACLE_SQL = {
    "store_applied": f"""{TABLES}, r AS (
  SELECT 'n' || event_id AS id, (event_id % 100) // 25 AS batch, event_id AS n, 'note ' || event_id AS content, CASE WHEN event_id % 3 = 0 THEN 0.3 END AS confidence,
    CASE WHEN event_id % 5 = 0 THEN 's' || event_id % 7 END AS subject, ['update', 'supersede', 'complement', 'force-new'][(event_id % 4)::INT + 1] AS action,
    'd' || CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE event_id * 7 % 260 END AS target, CASE WHEN event_id % 13 <> 0 THEN 'r' || event_id END AS reason,
    [{{'k': 'k' || event_id % 3, 'v': event_id::VARCHAR}}, {{'k': 'last', 'v': (event_id % 11)::VARCHAR}}] AS meta
  FROM events
), fit AS (
  SELECT * FROM r WHERE (action = 'complement' OR reason IS NOT NULL) AND (action IN ('complement', 'force-new') OR target IN (SELECT id FROM e))
), up AS (
  SELECT target, arg_max(content, (batch, n)) AS content, arg_max(confidence, (batch, n)) FILTER (WHERE confidence IS NOT NULL) AS confidence, arg_max(subject, (batch, n)) FILTER (WHERE subject IS NOT NULL) AS subject, string_agg(reason, ',' ORDER BY batch, n) AS reasons
  FROM fit WHERE action = 'update' GROUP BY target
), mk AS (
  SELECT target, string_agg(k || '=' || x, ',' ORDER BY k) AS metadata FROM (
    SELECT target, m.k AS k, arg_max(m.v, (batch, n)) AS x FROM (SELECT target, batch, n, unnest(meta) AS m FROM fit WHERE action = 'update') GROUP BY target, m.k) GROUP BY target
), su AS (
  SELECT target, arg_max(id, (batch, n)) AS by_id, arg_max(reason, (batch, n)) AS note FROM fit WHERE action = 'supersede' GROUP BY target
)
SELECT e.id, length(coalesce(up.content, e.content)) AS chars, round(coalesce(up.confidence, e.confidence), 6) AS confidence, coalesce(up.subject, e.subject) AS subject,
  CASE WHEN su.by_id IS NOT NULL THEN 'SUPERSEDED' ELSE e.flag END AS flag, coalesce(su.by_id, e.superseded_by) AS superseded_by, su.note AS flag_note,
  coalesce(mk.metadata, '') AS metadata, '' AS related_to, coalesce(up.reasons, '') AS reasons
FROM e LEFT JOIN up ON up.target = e.id LEFT JOIN mk ON mk.target = e.id LEFT JOIN su ON su.target = e.id
UNION ALL
SELECT id, length(content), coalesce(confidence, 0.5), subject, NULL, NULL, NULL,
  (SELECT string_agg(k || '=' || x, ',' ORDER BY k) FROM (SELECT m.k AS k, m.v AS x FROM (SELECT unnest(meta) AS m)
     UNION ALL SELECT 'supersedes', target WHERE action = 'supersede' UNION ALL SELECT 'supersede_reason', reason WHERE action = 'supersede' UNION ALL SELECT 'force_new_reason', reason WHERE action = 'force-new')),
  CASE WHEN action = 'complement' THEN target ELSE '' END, ''
FROM fit WHERE action <> 'update'
""",
}
