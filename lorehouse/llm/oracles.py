"""DuckDB SQL for those queries that SQL can express."""

OP1 = """
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)::DOUBLE[] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id, c.number AS other, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.number <> c.number AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id, other) AS rank FROM s)
WHERE rank <= 10
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))) END AS s
  FROM w
), c AS (
  SELECT min(doc_id) AS rep, s, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s
), u AS (
  SELECT rep, n, unnest(s) AS x FROM c
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT rep AS a, rep AS b FROM c
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), k AS (
  SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a
), m AS (
  SELECT c.s, k.component_id FROM c JOIN k ON k.rep = c.rep
)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(m.component_id, g.doc_id) AS component_id, g.doc_id = coalesce(m.component_id, g.doc_id) AS kept
FROM g LEFT JOIN m ON g.s = m.s
"""

OP7 = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS lim FROM s
), r AS (
  SELECT *, lim / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w
), t AS (
  SELECT source, source_size, least(lim, w * coalesce(arg_min((budget - capped) / rest, ratio) FILTER (WHERE (budget - capped) / rest < ratio) OVER (), lim / w)) AS target
  FROM r
), g AS (
  SELECT source, h, sum(size) AS sz FROM d GROUP BY source, h
), c AS (
  SELECT g.*, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS whole,
         t.target - floor(t.target / nullif(t.source_size, 0)) * t.source_size AS rest,
         coalesce(sum(sz) OVER (PARTITION BY g.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, max(CASE WHEN before <= rest THEN h END) OVER (PARTITION BY source) AS edge FROM c
)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (d.size * CASE WHEN e.source_size > 0 THEN e.whole + (CASE WHEN e.h < e.edge OR (e.h = e.edge AND e.before + e.sz - e.rest <= e.rest - e.before) THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""

def _nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


_NIBBLES = [_nibble(i) for i in range(16)]
_LOW = f"xor({_NIBBLES}[(xor(c, b) & 15) + 1], c >> 4)"
_CRC = f"xor({_NIBBLES}[(xor({_LOW}, b >> 4) & 15) + 1], {_LOW} >> 4)"

OP3 = f"""
WITH d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, b: {_CRC}), 4294967295::BIGINT) AS text_crc32
  FROM documents
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS place FROM d
), s AS (
  SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INT AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s
"""

_ID_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, b: {_CRC}), 4294967295::BIGINT)"

OP11 = f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(t ORDER BY pos) AS own, {_ID_CRC} % 6 AS h FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) AS path
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
), m AS (
  SELECT conv_id, len(path) AS length, d AS depth, sha256(list_slice(path, 1, d)::VARCHAR) AS node,
         CASE WHEN d > 0 THEN sha256(list_slice(path, 1, d - 1)::VARCHAR) END AS above, CASE WHEN d > 0 THEN length(path[d].text) ELSE 0 END AS n
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM r)
), n AS (
  SELECT depth, node, above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM m GROUP BY depth, node, above
), k AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.above = n.node AND x.depth = n.depth + 1) AS n_children
  FROM n LEFT JOIN n p ON p.node = n.above AND p.depth = n.depth - 1
), w AS (
  SELECT DISTINCT a.depth AS depth, a.node AS node, b.depth AS under_depth, b.node AS under
  FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), z AS (
  SELECT w.depth, w.node, sum(k.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM w JOIN k ON k.node = w.under AND k.depth = w.under_depth GROUP BY w.depth, w.node
)
SELECT conv_id, k.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM k JOIN z ON k.node = z.node AND k.depth = z.depth
"""


def _op12() -> str:
    """Four rounds of assignment and means, written out; distances are whole numbers below 2**53, so doubles hold them."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS n, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), x AS MATERIALIZED (
  SELECT n, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM v, range(4) r(p)
), e0 AS MATERIALIZED (
  SELECT p, n AS e, x AS c FROM x WHERE n < 256
)"""
    ]
    for i in range(5):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT n, x.p, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS a
  FROM x JOIN e{i} ON x.p = e{i}.p GROUP BY n, x.p
)""")
        if i < 4:
            steps.append(f"""e{i + 1} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM e{i} o LEFT JOIN (
    SELECT p, e, list(c ORDER BY j)::DOUBLE[] AS c FROM (
      SELECT x.p, a % 256 AS e, j, floor(sum(x[j]) / count(*)) AS c
      FROM x JOIN a{i} ON x.n = a{i}.n AND x.p = a{i}.p, range(1, 65) r(j) WHERE j <= len(x) GROUP BY x.p, a % 256, j
    ) GROUP BY p, e) m ON m.p = o.p AND m.e = o.e
)""")
    return f"""WITH {", ".join(steps)}, s AS (
  SELECT n, string_agg(printf('%02x', a % 256), '' ORDER BY p) AS code, sum(a // 256)::BIGINT AS error FROM a4 GROUP BY n
), h AS (
  SELECT sha256(coalesce(string_agg(list_aggregate(list_transform(c, lambda y: y::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM e4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN s ON v.n = s.n, h
"""


ORACLE_SQL = {"op1_topk": OP1, "op2_near_duplicates": OP2, "op3_shards": OP3, "op7_mix": OP7, "op11_prefix_trie": OP11, "op12_codes": _op12()}
