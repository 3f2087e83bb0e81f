"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(encode(h)) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (s)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP8 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a AS vec_id, a AS r FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, t.vec_id) AS component_id,
       coalesce(c.component_id, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

SQL = {"op2_warc": OP2, "op7_minhash_dedup": OP7, "op8_embedding_dedup": OP8}


def _op12(rounds: int = 5, k: int = 40) -> str:
    """Each round is one step: nearest centroid of each vector, then floors of the means."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, m.d AS d, m.c AS c FROM (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS m
    FROM v CROSS JOIN c{i} GROUP BY r))"""
    means = """
c{j} AS MATERIALIZED (
  SELECT c, coalesce(nv, cv) AS cv FROM c{i} LEFT JOIN (
    SELECT c, list(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END ORDER BY p) AS nv FROM (
      SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY c, p)
    GROUP BY c) USING (c))"""
    steps = ",".join(nearest.format(i=i) + "," + means.format(i=i, j=i + 1) for i in range(rounds)) + "," + nearest.format(i=rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS cv FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
{steps}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


SQL["op12_centroid_clusters"] = _op12()

#: Checksum of a short text, damage, faults, then the cheapest edits row by row: a struct of cost,
#: audit and repaired text for each of: the beginning (b), after s, after u, after an answer (t).
SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE g AS (
  SELECT DISTINCT conv_id FROM conversations),
n AS (SELECT conv_id, row_number() OVER () AS c FROM g),
k AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(n.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda h, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(h, x)), 4294967295), 4294967295) % 20 AS d
  FROM conversations JOIN n ON n.conv_id IS NOT DISTINCT FROM conversations.conv_id),
r AS (
  SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k CROSS JOIN (VALUES (1), (2)) t(i) WHERE d <> 0 AND (i = 1 OR d = 3)),
o AS (
  SELECT *, left(role, 1) AS f, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) AS again FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, again) AS p FROM o),
x AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN again > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(f) OVER (PARTITION BY c ORDER BY p) AS before FROM q),
dp AS (
  SELECT c, CAST(0 AS BIGINT) AS p, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS b, far AS s, far AS u, far AS t
  FROM n CROSS JOIN (SELECT {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS far)
  UNION ALL
  SELECT c, p, {'c': b.c + 2, 'a': b.a || 'D', 't': b.t},
    least({'c': s.c + 2, 'a': s.a || 'D', 't': s.t}, CASE WHEN ok AND f = 's' THEN {'c': b.c + e, 'a': b.a || 'K', 't': list_append(b.t, line)} END),
    least({'c': u2.c + 2, 'a': u2.a || 'D', 't': u2.t},
      CASE WHEN ok AND f = 'u' THEN {'c': open.c + e, 'a': open.a || 'K', 't': list_append(open.t, line)} END,
      CASE WHEN ok THEN {'c': open.c + e + 1, 'a': open.a || 'R', 't': list_append(open.t, 'user:' || text)} END),
    least({'c': t2.c + 2, 'a': t2.a || 'D', 't': t2.t},
      CASE WHEN ok AND f = 'a' THEN {'c': u2.c + e, 'a': u2.a || 'K', 't': list_append(u2.t, line)} END,
      CASE WHEN ok THEN {'c': u2.c + e + 1, 'a': u2.a || 'R', 't': list_append(u2.t, 'assistant:' || text)} END)
  FROM (SELECT *, least(b, s, t2) AS open FROM (
    SELECT *, least(t, {'c': u2.c + 5, 'a': u2.a || 'I', 't': list_append(u2.t, 'assistant:')}) AS t2 FROM (
      SELECT dp.c, x.p, x.f, x.text, x.role || ':' || x.text AS line, fault IN (0, 3) AS ok, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS e, b, s, t,
        least(u, {'c': least(b, s, t).c + 5, 'a': least(b, s, t).a || 'I', 't': list_append(least(b, s, t).t, 'user:')}) AS u2
      FROM dp JOIN x ON x.c = dp.c AND x.p = dp.p + 1)))),
l AS (SELECT c, max(p) AS p FROM dp GROUP BY c),
z AS (
  SELECT c, least(b, t, {'c': u2.c + 5, 'a': u2.a || 'I', 't': list_append(u2.t, 'assistant:')}) AS w FROM (
    SELECT dp.c, b, t, least(u, {'c': s.c + 5, 'a': s.a || 'I', 't': list_append(s.t, 'user:')}) AS u2 FROM dp JOIN l USING (c, p))),
m AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || f NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(array_to_string(w.t, chr(10))) AS repaired_sha256
FROM n JOIN z USING (c) LEFT JOIN m USING (c)
"""
