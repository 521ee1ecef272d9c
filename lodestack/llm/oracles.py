"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null' || coalesce(text, '')) || 'mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
sized AS (SELECT *, length(bin(size))::BIGINT AS digits FROM base),
src AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM base GROUP BY key, source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
capped AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS edge FROM weighted),
run AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS spent, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS remaining, sum(source_size) OVER () AS total
        FROM capped WINDOW b AS (ORDER BY edge, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce((SELECT (total - spent)::DOUBLE / remaining FROM run WHERE (total - spent)::DOUBLE / remaining <= edge ORDER BY edge, source LIMIT 1), 0) AS t),
goal AS (SELECT key, source_size, least(cap::DOUBLE, w * t) AS target FROM capped, level),
kinds AS (SELECT key, digits, sum(size)::BIGINT AS words FROM sized GROUP BY key, digits),
kcap AS (SELECT k.*, g.source_size, g.target, k.words * k.digits AS w, 3 * k.words AS cap,
                CASE WHEN k.words > 0 THEN (3 * k.words)::DOUBLE / (k.words * k.digits) ELSE 0 END AS edge FROM kinds k JOIN goal g USING (key)),
krun AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS spent, sum(w) OVER (PARTITION BY key) - coalesce(sum(w) OVER b, 0) AS remaining
         FROM kcap WINDOW b AS (PARTITION BY key ORDER BY edge, digits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ktry AS (SELECT *, CASE WHEN remaining > 0 THEN (target - spent) / remaining END AS t FROM krun),
kt AS (SELECT key, arg_min(t, (edge, digits)) AS t FROM ktry WHERE t <= edge GROUP BY key),
expected AS (SELECT k.key, k.digits, k.words, k.source_size, k.target,
                    CASE WHEN k.source_size = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE, coalesce(kt.t * k.digits, 3.0::DOUBLE)) END AS e
             FROM kcap k LEFT JOIN kt USING (key)),
plan AS (SELECT *, floor(e) AS whole, e - floor(e) AS p, target - sum(floor(e) * words) OVER (PARTITION BY key) AS due FROM expected),
odds AS (SELECT s.doc_id, s.key, s.size, q.source_size, q.target, q.whole, q.p, q.due,
                CASE WHEN q.p > 0 THEN s.u / (1 - s.u) / (q.p / (1 - q.p)) END AS odds FROM sized s JOIN plan q USING (key, digits)),
ranked AS (SELECT *, sum(size) OVER (PARTITION BY key ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM odds),
picked AS (SELECT *, (whole + CASE WHEN odds IS NOT NULL AND upto - size / 2.0 <= due THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, p FROM picked
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT r.x, min(r.y) AS component_id FROM r GROUP BY r.x),
f AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM f)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.class_id, d.doc_id) AS class_id
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP7 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS hex FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper, count(*) OVER (PARTITION BY hex) AS copies FROM d)
SELECT page_id, n AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN copies > 1 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copies > 1 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""

#: For tables whose pages declare no canonical link or redirect, as the test tables; aliases are tested by fixture.
OP8 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT n.page_id, n.host, n.path,
       (SELECT r.rh || r.rp FROM rules r WHERE (n.host = r.rh OR ends_with(n.host, '.' || r.rh)) AND starts_with(n.path, r.rp) ORDER BY length(r.rh || r.rp) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.verdict FROM rules r WHERE (n.host = r.rh OR ends_with(n.host, '.' || r.rh)) AND starts_with(n.path, r.rp) ORDER BY length(r.rh || r.rp) DESC LIMIT 1), 'allow') AS verdict
FROM named n
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2, "op4_mixing": OP4, "op7_warc": OP7, "op8_url_filters": OP8}
