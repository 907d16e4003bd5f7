"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_sharding"] = """WITH b AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, text, coalesce(source, '') AS s, source IS NULL AS z,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
  r AS (SELECT *, (2 * row_number() OVER (PARTITION BY s, z ORDER BY h) - 1) / (2 * count(*) OVER (PARTITION BY s, z)) AS f FROM b),
  p AS (SELECT *, row_number() OVER (ORDER BY f, z, s, h) - 1 AS p, count(*) OVER () AS total FROM r),
  crc AS (SELECT CAST(i AS BIGINT) AS i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) for x in range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
  tb AS (SELECT list(v ORDER BY i) AS t FROM crc)
  SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * CAST(size - 8 AS BIGINT), 2), lambda k: CAST(('0x' || substr(x, k, 2)) AS BIGINT))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32,
    'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard, CAST(p - ((p * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS x FROM p), tb"""

SQL["op2_tool_calls"] = """WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
  c AS (SELECT conv_id, turn, text FROM m WHERE role = 'user'),
  dp AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM c WHERE (conv_id, turn - 2) NOT IN (SELECT (conv_id, turn) FROM c)
    UNION ALL SELECT c.conv_id, c.turn, dp.depth + 1 FROM dp JOIN c ON c.conv_id = dp.conv_id AND c.turn = dp.turn + 2),
  l AS (SELECT c.conv_id, c.turn, c.text, dp.depth, a.text AS answer FROM c JOIN dp ON dp.conv_id = c.conv_id AND dp.turn = c.turn LEFT JOIN m a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant')
  SELECT conv_id, conv_id || '-' || turn AS call_id, 'reply' AS name, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn) - 1 AS BIGINT) AS place, depth, CASE WHEN answer IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    CAST(CASE WHEN answer IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results, true AS valid, '' AS problems,
    '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":"' || conv_id || '-' || turn || '","name":"reply","result":' || coalesce(CAST(to_json(answer) AS VARCHAR), 'null') || '}' AS record FROM l
  UNION ALL SELECT conv_id, conv_id || '-' || (turn - 1), NULL, turn, NULL, NULL, 'orphan', 1, false, 'no such call', '{"id":"' || conv_id || '-' || (turn - 1) || '","result":' || to_json(text) || '}'
  FROM m WHERE role = 'assistant' AND (conv_id, turn - 1) NOT IN (SELECT (conv_id, turn) FROM c)"""

SQL["op9_jaccard_join"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT w.doc_id, CAST(count(g) AS BIGINT) AS n FROM w LEFT JOIN sh ON sh.doc_id = w.doc_id GROUP BY 1),
  lk AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
  rc AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT lk.b, rc.root FROM rc JOIN lk ON lk.a = rc.node)
  SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN rc ON rc.node = n.doc_id GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
