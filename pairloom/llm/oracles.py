"""DuckDB SQL for the rows of those queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0))),
dw AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT rid, size, i, item FROM dw JOIN bw USING (size, words)),
covered AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT rid, size, i FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (rid) LEFT JOIN named n USING (rid)
""",
    "op13_systematic_mix": r"""
WITH d AS (SELECT doc_id, source, source IS NULL AS none, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT none, source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY none, source) - 1) % 3] AS weight FROM d GROUP BY 1, 2),
v AS (SELECT *, (3 * source_size)::DOUBLE / weight AS level FROM s),
h AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY level, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY level, none, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM v),
t AS (SELECT none, source, source_size, least(3.0::DOUBLE * source_size, coalesce((SELECT share FROM h WHERE level > share ORDER BY level, none, source LIMIT 1) * weight, 3.0::DOUBLE * source_size)) AS target,
  (CAST('0x' || substr(md5(concat_ws('|', 0, source)), 1, 4) AS BIGINT) + 0.5::DOUBLE) / 65536 AS first FROM h),
c AS (SELECT *, CASE WHEN size < 64 THEN size ELSE 32 * (length(format('{:b}', size)) - 6) + (size >> (length(format('{:b}', size)) - 6)) END AS class FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY none, source ORDER BY class, md5(concat_ws('|', doc_id, size)), doc_id) - 1 AS k FROM c),
r AS (SELECT p.doc_id, p.size, source_size, target, p.source, first, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
  FROM p JOIN t ON p.none = t.none AND coalesce(p.source, '') = coalesce(t.source, ''))
SELECT doc_id, size, source_size, target, CAST(size * (floor(first + ratio * (k + 1)) - floor(first + ratio * k)) AS BIGINT) AS taken, source, CAST(floor(first + ratio * (k + 1)) - floor(first + ratio * k) AS INT) AS copies FROM r
""",
    "op12_prefix_trie": r"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, (4294967295 - list_reduce(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT),
  lambda x, b: list_reduce(range(8), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)), xor(x, b)), 4294967295::BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM c)),
b AS (SELECT f.conv_id, c.k, role, text FROM f JOIN c ON c.conv_id = f.conv_id - f.conv_id % 20 AND c.k < f.h),
n AS (SELECT f.conv_id, h, count(b.k) AS m FROM f LEFT JOIN b USING (conv_id) GROUP BY 1, 2),
t AS (SELECT * FROM b UNION ALL SELECT c.conv_id, c.k + m - h, role, text FROM c JOIN n USING (conv_id) WHERE c.k >= h),
l AS (SELECT n.conv_id, count(t.k) AS length FROM n LEFT JOIN t USING (conv_id) GROUP BY 1),
r AS (SELECT conv_id, k + 1 AS depth, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY k) AS name, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t
  UNION ALL SELECT conv_id, 0, '', 0 FROM l),
g AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) * (count(*) - 1) AS own FROM r GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, substr(name, 1, 64 * (CAST(depth AS BIGINT) - 1)) AS name, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k USING (depth, name)),
s AS (SELECT r.depth, r.name, sum(a.own) AS saved, count(*) FILTER (a.n_children = 0) AS leaves FROM a JOIN r ON r.conv_id = a.conv_id AND r.depth <= a.depth GROUP BY 1, 2),
e AS (SELECT depth, name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM r JOIN l USING (conv_id) WHERE depth = length GROUP BY 1, 2)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM a JOIN s USING (depth, name) LEFT JOIN e USING (depth, name) LEFT JOIN g p ON p.depth = a.depth - 1 AND p.name = substr(a.name, 1, 64 * (CAST(a.depth AS BIGINT) - 1))
""",
    "op11_threshold_seeded_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
z AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, term, len(w) AS n, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM d) GROUP BY rid, doc_id, term, n),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, z WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
s AS (SELECT item, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS score FROM i JOIN f USING (term) JOIN p USING (term), z GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, rid) AS r FROM s WHERE score > 0) WHERE r <= 10
""",
}
