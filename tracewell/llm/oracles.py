"""DuckDB SQL for the operators that SQL can express."""

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP4 = f"""
WITH RECURSIVE u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
  {ASCII}) AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
  regexp_extract(coalesce(url, ''), '://[^?#]*\\?([^#]*)', 1, 's') AS qs FROM pages),
t AS (SELECT DISTINCT url, unnest(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
  list_transform(string_split(path, '/'), lambda x: 'p:' || translate(x,
  {ASCII})), list_transform(string_split(qs, '&'), lambda x: 'q:' || string_split(x, '=')[1]))) AS tok FROM u WHERE url IS NOT NULL),
tok AS (SELECT url, tok FROM t WHERE length(tok) > 2),
bag AS (SELECT url, list_sort(list(tok)) AS ts FROM tok GROUP BY url),
train AS (SELECT row_number() OVER () AS id, bag.ts, l.quality = 0 AS bad FROM labels l JOIN pages p ON p.page_id = l.doc_id
  JOIN bag ON bag.url = p.url WHERE l.quality IS NOT NULL),
rate AS (SELECT count(*) FILTER (WHERE bad) AS bad, count(*) AS n, greatest(3,
  CAST(ceil(0.0005 * count(*) FILTER (WHERE bad)) AS BIGINT)) AS least FROM train),
s(id, ts, chosen, last) AS (SELECT id, ts, CAST([] AS VARCHAR[]), 0 FROM train WHERE bad UNION ALL
  SELECT id, ts, list_append(chosen, ts[j]), j FROM (SELECT id, ts, chosen, unnest(generate_series(last + 1, len(ts))) AS j FROM s)),
sets AS (SELECT chosen, count(*) AS bad FROM s WHERE len(chosen) > 0 GROUP BY chosen HAVING count(*) >= (SELECT least FROM rate)),
held AS (SELECT chosen, any_value(sets.bad) AS k, CAST(count(*) AS DOUBLE) AS n FROM sets
  JOIN train ON list_has_all(train.ts, sets.chosen) GROUP BY chosen),
rules AS (SELECT chosen, k / n AS conf FROM held WHERE k / n >= 0.5
  AND round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n),
  12) > (SELECT round(bad / CAST(n AS DOUBLE), 12) FROM rate)),
f AS (SELECT bag.url, max(conf) AS conf FROM bag JOIN rules ON list_has_all(bag.ts, rules.chosen) GROUP BY bag.url),
g(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow',
  'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) x JOIN g ON (x.host = g.h OR ends_with(x.host, '.' || g.h)) AND starts_with(x.path, g.p)
  GROUP BY host, path)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict,
  CASE WHEN f.conf IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN b.rule IS NULL THEN f.conf END AS confidence
FROM u LEFT JOIN b ON b.host = u.host AND b.path = u.path LEFT JOIN f ON f.url = u.url
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT page_id, n, sha1(html) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS response FROM r WHERE n >= 1000 GROUP BY digest)
SELECT r.page_id, CAST(r.n AS BIGINT) AS payload_bytes, r.digest AS payload_digest,
  CASE WHEN m.response <> r.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.response <> r.page_id THEN m.response END AS refers_to
FROM r LEFT JOIN m ON r.digest = m.digest AND r.n >= 1000
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e,
  lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS s FROM (SELECT doc_id, hx, unnest(generate_series(0, n - 50)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT w.doc_id, w.p FROM w JOIN m ON m.s = w.s WHERE w.doc_id > m.first),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
k AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
c AS (SELECT q.doc_id, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), ''
  ORDER BY a) AS head, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM q JOIN d ON d.doc_id = q.doc_id
  GROUP BY q.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(c.head, '') || substr(d.hx, 2 * coalesce(c.b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH q AS (SELECT DISTINCT item_id, unnest(list_distinct({TERMS})) AS term FROM benchmark),
d AS (SELECT doc_id, {TERMS} AS ts FROM documents), n AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
s AS (SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term JOIN n ON n.doc_id = tf.doc_id, c GROUP BY item_id, tf.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

OP13 = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
k AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < 50 AS INTEGER)
  + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
  + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INTEGER)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(t.doc_id > first, false) AS INTEGER) AS mask
  FROM t LEFT JOIN k ON k.doc_id = t.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before, bits[k] AS own
  FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)),
r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (WHERE mask & (before + own) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL = {"op4_url_rules": OP4, "op5_warc_bundles": OP5, "op9_embedding_near_dedup": OP9, "op10_suffix_array_dedup": OP10,
    "op11_ranked_lexical_search": OP11, "op13_filter_interaction_audit": OP13}
