"""SQL counterparts of the text queries that SQL can express, over whole tables."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS UBIGINT) >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""

OP5 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, UNNEST(range(1, CAST(len(w) - 1 AS BIGINT))) AS i, w FROM d WHERE len(w) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM b GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS mm, CAST(count(*) AS DOUBLE) AS k, sum(n * (f / n) * (f / n)) AS sq, sum(n * n) AS nn FROM h),
s AS (SELECT mean, (sq / mm - mean * mean - mean * (1 - mean) * (k - 1) / mm) / nullif(1 - nn / (mm * mm), 0) AS spread FROM a),
q AS (SELECT mean, CASE WHEN coalesce(spread, 0) <= 0 THEN 1e6 ELSE least(1e6, greatest(2.0, mean * (1 - mean) / spread - 1)) END AS strength FROM s),
v AS (SELECT source, mean * strength + f AS x, (1 - mean) * strength + n - f AS y FROM h, q),
r AS (SELECT source, x / (x + y) - 3 * sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))) > 0.8 AS rejected FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source"""

OP7 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, UNNEST(range(1, CAST(len(w) - 48 AS BIGINT))) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sha256(array_to_string(w[i:i + 49], ' '))) AS first_id FROM x),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, UNNEST(range(i, i + 50)) AS j FROM k WHERE first_id < doc_id) GROUP BY doc_id),
u AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(1, CAST(len(w) + 1 AS BIGINT))) AS j FROM d JOIN g USING (doc_id)),
t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY j) FILTER (z.j2 IS NULL) AS kept FROM u LEFT JOIN (SELECT doc_id AS id2, UNNEST(gone) AS j2 FROM g) z ON z.id2 = u.doc_id AND z.j2 = u.j GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g FROM (SELECT doc_id, w, UNNEST(range(1, greatest(CAST(len(w) - 2 AS BIGINT), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v WHERE r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""

ORACLE = {"op2_warc": OP2, "op5_hostrules": OP5, "op7_substring": OP7, "op10_minhash": OP10}
