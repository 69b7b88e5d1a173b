"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
d AS (SELECT doc_id, ws, sha256(array_to_string(ws, ' ')) AS body FROM w WHERE len(ws) > 0),
g AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram, count(*) AS n FROM (SELECT *, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM d) GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS total FROM g GROUP BY 1),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM s JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE shared >= 0.8 * (x.total + y.total - shared)
  UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.body = b.body AND a.doc_id < b.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node)
SELECT node AS doc_id, min(seen) AS class_id, node = min(seen) AS kept FROM r GROUP BY 1
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
c AS (SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS gram FROM (SELECT *, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) > 12)),
o AS (SELECT gram, min(doc_id) AS owner FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN o USING (gram), range(13) AS r(k) WHERE owner < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
