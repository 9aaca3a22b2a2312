"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .urls import RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WS_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS gram FROM s),
lens AS (SELECT DISTINCT n FROM wins),
q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens),
hits AS (SELECT doc_id, p, q.n, item FROM q JOIN wins ON wins.n = q.n AND wins.gram = array_to_string(w[p : p + q.n - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {WS_WORDS} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS x FROM f),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
k AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.x) AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.x = w.x WHERE c.x IS NULL GROUP BY w.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP5 = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, line, p, {LOWER.format(f"trim(line, {BLANK})")} AS key FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM s)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, line, p, k.key IS NOT NULL AND last <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP9 = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(str(x) for x in RULES)}) AS t(rh, rp, rv)),
b AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)
"""

#: CRC-32 is linear: a byte's share depends on the byte and on how many follow it (d); byte -1 is the start value, 0xFFFFFFFF.
OP11 = r"""
WITH RECURSIVE
words AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 't', NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
places AS (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT side, id, w[i] AS g FROM places
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
step(k, b, v) AS (SELECT 0, b, b FROM range(256) t(b)
  UNION ALL SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT b, v FROM step WHERE k = 8),
kinds AS (SELECT g, hex(g) AS h, strlen(g) AS n FROM (SELECT DISTINCT g FROM grams)),
share(d, b, v) AS (SELECT 0, b, v FROM tab UNION ALL SELECT 0, -1, CAST(4294967295 AS BIGINT)
  UNION ALL SELECT d + 1, share.b, xor(tab.v, share.v >> 8) FROM share JOIN tab ON tab.b = share.v & 255 WHERE d < (SELECT max(n) FROM kinds)),
bytes AS (SELECT g, n - 1 - i AS d, CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT) AS b FROM (SELECT g, h, n, unnest(range(n)) AS i FROM kinds)
  UNION ALL SELECT g, n, -1 FROM kinds),
crc AS (SELECT g, xor(bit_xor(v), 4294967295) % 10000 AS bucket FROM bytes JOIN share USING (d, b) GROUP BY g),
found AS (SELECT side, id, bucket FROM grams JOIN crc USING (g)),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM found GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (SELECT bucket, CAST(floor(1000e0 * ln((CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts, totals),
sums AS (SELECT id, sum(gain) AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000e0 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM words LEFT JOIN sums USING (id) WHERE side = 'd'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 5 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

#: Vectors and centroids as lists of integers.
_KEPT = """
kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, q AS c FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16)"""


def _nearest(k: int) -> str:
    return f"""a{k} AS (SELECT vec_id, q, unnest(min_by({{'cluster': cluster, 'distance': d}}, (d, cluster))) FROM (
    SELECT vec_id, q, cluster, CAST(list_sum(list_transform(range(1, 65), lambda j: (q[j] - c[j]) * (q[j] - c[j]))) AS BIGINT) AS d FROM kept, c{k}) GROUP BY vec_id, q)"""


def _moved(k: int) -> str:
    sums = f"SELECT cluster, list(m ORDER BY j) AS m FROM (SELECT cluster, j, CAST(floor(sum(q[j])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{k - 1}, range(1, 65) t(j) GROUP BY cluster, j) GROUP BY cluster"
    return f"c{k} AS (SELECT cluster, coalesce(m, c) AS c FROM c{k - 1} LEFT JOIN ({sums}) USING (cluster))"


OP12 = f"""
WITH {_KEPT}, {", ".join(x for k in range(3) for x in (_nearest(k), _moved(k + 1)))}, {_nearest(3)}
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""

OP13 = """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda j: a.q[j] * b.q[j])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
QUALIFY rank <= 20
"""
