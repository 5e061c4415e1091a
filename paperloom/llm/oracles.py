"""DuckDB texts for the corpus queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, list_slice(ws, k, k + least(len(ws), 10) - 1) AS words
  FROM item, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(k) WHERE len(ws) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), place AS (
  SELECT doc_id, k, n, list_slice(ws, k, k + n - 1) AS words
  FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(ws) - n + 2)) AS t(k)
), hit AS (
  SELECT doc_id, k, place.n AS n, item_id FROM place JOIN win USING (words)
), hit_words AS (
  SELECT doc_id, count(DISTINCT k + i) AS n_hit FROM hit, unnest(range(0, n)) AS t(i) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + length('<|turn|><|text|><|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), m AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM h
), r AS (
  SELECT *, row_number() OVER () AS id, CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
    '^^' || regexp_replace(regexp_replace(lower(replace(url, '^', '~')), '[0-9]', '0', 'g'), '[^a-z0./\-_:?=&%#@+~]', '~', 'g') AS f FROM m
), c AS (
  SELECT id, ruled, f[k:k] AS a, f[k + 1:k + 1] AS b, f[k + 2:k + 2] AS s FROM r, unnest(range(1, length(f) - 1)) AS t(k)
), abc AS (
  SELECT ruled AS kind, a, b, s, CAST(count(*) AS DOUBLE) AS n FROM c WHERE ruled IS NOT NULL GROUP BY ALL
), ab AS (SELECT kind, a, b, sum(n) AS n_ab, count(*) AS k_ab FROM abc GROUP BY ALL
), bs AS (SELECT kind, b, s, sum(n) AS n_bs FROM abc GROUP BY ALL
), b1 AS (SELECT kind, b, sum(n_bs) AS n_b, count(*) AS k_b FROM bs GROUP BY ALL
), s1 AS (SELECT kind, s, sum(n_bs) AS n_s FROM bs GROUP BY ALL
), z AS (SELECT kind, coalesce(sum(n_s), 0) AS n_z, count(n_s) AS k_z FROM (VALUES ('allow'), ('block')) AS v(kind) LEFT JOIN s1 USING (kind) GROUP BY ALL
), cell AS (
  SELECT a, b, s, kind,
    (coalesce(n_s, 0) + k_z / 41.0 + 1.0 / 41) / (n_z + k_z + 1.0) AS p0, n_bs, n_b, k_b, abc.n AS n, n_ab, k_ab
  FROM (SELECT DISTINCT a, b, s FROM c) AS d CROSS JOIN z LEFT JOIN s1 USING (kind, s) LEFT JOIN bs USING (kind, b, s) LEFT JOIN b1 USING (kind, b)
    LEFT JOIN abc USING (kind, a, b, s) LEFT JOIN ab USING (kind, a, b)
), p1 AS (SELECT *, CASE WHEN n_b > 0 THEN (coalesce(n_bs, 0) + k_b * p0) / (n_b + k_b) ELSE p0 END AS q1 FROM cell
), p2 AS (SELECT a, b, s, kind, ln(CASE WHEN n_ab > 0 THEN (coalesce(n, 0) + k_ab * q1) / (n_ab + k_ab) ELSE q1 END) AS l FROM p1
), ratio AS (SELECT a, b, s, sum(CASE WHEN kind = 'allow' THEN l ELSE -l END) AS d FROM p2 GROUP BY ALL
), score AS (SELECT id, round(avg(d), 9) AS score FROM c JOIN ratio USING (a, b, s) GROUP BY id
), cal AS (
  SELECT avg(score) FILTER (ruled = 'allow') AS ma, avg(score) FILTER (ruled = 'block') AS mb,
    greatest(coalesce(stddev_pop(score) FILTER (ruled = 'allow'), 0), 1e-6) AS sa, greatest(coalesce(stddev_pop(score) FILTER (ruled = 'block'), 0), 1e-6) AS sb
  FROM r JOIN score USING (id) WHERE ruled IS NOT NULL
), th AS (SELECT coalesce(round((ma * sb + mb * sa) / (sa + sb), 9), 0) AS threshold FROM cal)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(score, 0) >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN score USING (id) CROSS JOIN th
"""

OP6 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN first_id END AS refers_to
FROM m
"""

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[][] WHEN len(w) < 5 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: list_slice(w, k, k + 4))) END) AS s FROM d
), h AS (SELECT doc_id, md5(array_to_string(s, chr(1))) AS s FROM g
), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE e.b > r.root
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) USING (doc_id)
"""

#: One-edit pairs by the words' deletions: two words of one length share one at the same place, of two words whose lengths
#: differ by one the shorter is a deletion of the longer. CRC-32 is computed byte by byte from its polynomial.
OP12 = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS UINTEGER) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
), one AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY ALL
), h AS (
  SELECT w, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(doc_id || ':' || w)),
    lambda k: CAST(('0x' || substr(hex(encode(doc_id || ':' || w)), 2 * k + 1, 2)) AS BIGINT))),
    lambda x, y: xor(x >> 8, t[CAST(xor(x & 255, y) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM one, tab
), v AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, sum(c) AS n
  FROM h GROUP BY 1
), words AS (SELECT word, CAST(n AS BIGINT) AS n FROM v WHERE length(word) >= 5 AND n >= 3
), dels AS (SELECT word, n, k, left(word, CAST(k - 1 AS INTEGER)) || substr(word, CAST(k + 1 AS INTEGER)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM dels a JOIN dels b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n FROM near GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain(word, stand) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.stand WHERE f.form IS NOT NULL)
SELECT f.*, chain.stand AS root FROM f JOIN chain USING (word) JOIN f g ON g.word = chain.stand WHERE g.form IS NULL
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS own, left(filter_order, CAST(step - 1 AS INTEGER)) AS earlier FROM orders, range(1, 6) t(step)
), g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails
), x AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fails, len(list_filter(fails, lambda y: y)) = 1 AS sole,
    len(list_filter(string_split(earlier, ''), lambda y: y <> '' AND fails[ascii(y) - 64])) > 0 AS gone FROM g, steps
), s AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND sole), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM s
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, k, md5(array_to_string(list_slice(w, k, k + 34), ' ')) AS s FROM d, unnest(range(1, len(w) - 33)) t(k)
), twice AS (SELECT r, k FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)
), word AS (SELECT r, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) t(j)
), last AS (
  SELECT word.r, j, word, max(k) OVER (PARTITION BY word.r ORDER BY j) AS k FROM word LEFT JOIN twice ON twice.r = word.r AND twice.k = word.j
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM last WHERE k IS NULL OR k < j - 34 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
