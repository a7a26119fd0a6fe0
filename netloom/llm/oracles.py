"""DuckDB twins of the operators that SQL can express. Fixed values are written out here, not taken from the operators."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
again AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) >= 2),
rep AS (SELECT doc_id, count(*) AS n FROM (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM g JOIN again USING (doc_id, g)) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lin.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lin.n, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS soft,
    200 * n_symbols > 5 * word_chars OR 200 * n_dup_lines > 50 * n_lines AS strict FROM m),
h AS (SELECT source, count(*) AS docs, CAST(sum(CASE WHEN base_failed OR soft THEN 1 ELSE 0 END) AS BIGINT) AS f FROM r GROUP BY source),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(f * 1000000 // docs) AS DOUBLE) AS a,
  CAST(sum((f * 1000000 // docs) * (f * 1000000 // docs)) AS DOUBLE) AS b FROM h),
mv AS (SELECT a / n / 1e6 AS mean, b / n / 1e12 - (a / n / 1e6) * (a / n / 1e6) AS var FROM s),
k AS (SELECT mean, CASE WHEN var <= 1e-9 THEN 1e4 ELSE least(1e4, greatest(1.0::DOUBLE, mean * (1 - mean) / var - 1)) END AS w FROM mv),
v AS (SELECT source, (f + mean * w) / (docs + (mean * w + (1 - mean) * w)) AS shrunk FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN shrunk > 0.5 THEN NOT strict WHEN shrunk < 0.02 THEN true ELSE NOT soft END AS kept,
  CASE WHEN shrunk > 0.5 THEN 'bad' WHEN shrunk < 0.02 THEN 'trusted' ELSE 'mixed' END AS host_verdict
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""

URL_RULES = r"""
WITH RECURSIVE u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, url,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
b AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS listed FROM l),
t AS (SELECT DISTINCT page_id, listed, tok FROM (
  SELECT page_id, listed, 'h:' || x AS tok, x FROM (SELECT page_id, listed, unnest(string_split(host, '.')) AS x FROM b)
  UNION ALL SELECT page_id, listed, 'w:' || x, x FROM (SELECT page_id, listed, unnest(string_split(y, '-')) AS x
    FROM (SELECT page_id, listed, unnest(string_split(host, '.')) AS y FROM b) WHERE contains(y, '-'))
  UNION ALL SELECT page_id, listed, 'p:' || x, x FROM (SELECT page_id, listed, string_split(y, '.')[1] AS x
    FROM (SELECT page_id, listed, unnest(string_split(path, '/')) AS y FROM b)))
  WHERE x <> '' AND NOT regexp_matches(x, '^[0-9]+$')),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tok) AS i FROM t WHERE tok NOT IN ('h:net', 'h:example', 'h:com', 'h:org', 'p:en', 'p:de', 'p:fr')),
g AS (SELECT page_id, listed, i, tok AS combo FROM o
  UNION ALL SELECT g.page_id, g.listed, o.i, g.combo || ' ' || o.tok FROM g JOIN o ON o.page_id = g.page_id AND o.i > g.i),
k AS (SELECT combo FROM g WHERE listed IS NOT NULL GROUP BY combo
  HAVING count(*) FILTER (listed = 'block') >= 10 AND (count(*) FILTER (listed = 'block'))::DOUBLE / count(*) >= 0.9),
f AS (SELECT DISTINCT page_id FROM g JOIN k USING (combo))
SELECT b.page_id, host, path, rule,
  coalesce(listed, CASE WHEN host <> '' AND f.page_id IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM b LEFT JOIN f ON b.page_id = f.page_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b, k, p.n AS na, q.n AS nb FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * k >= 4 * (p.n + q.n - k)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a)
SELECT d.doc_id,
  least(d.doc_id, coalesce((SELECT min(b) FROM e WHERE e.a = d.doc_id AND k = na AND k = nb), d.doc_id)) AS class_id,
  (SELECT min(o) FROM r WHERE r.doc_id = d.doc_id) AS group_id,
  (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links
FROM d
"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
one AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
g AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w),
two AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM g WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT t.lang, w1 || ' ' || w2 AS phrase, t.f AS a, x.f AS l, y.f AS r,
    CAST(1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score,
    (SELECT max(f) FROM three z WHERE z.lang = t.lang AND ((z.w1 = t.w1 AND z.w2 = t.w2) OR (z.w2 = t.w1 AND z.w3 = t.w2))) AS longest
  FROM two t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN one y ON y.lang = t.lang AND y.phrase = t.w2),
c3 AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS f1, q.f AS f23, p.f AS f12, z.f AS f3,
    CAST(1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * q.f) AS BIGINT) AS s1, CAST(1000000::HUGEINT * t.f * t.f // (p.f::HUGEINT * z.f) AS BIGINT) AS s2
  FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN one z ON z.lang = t.lang AND z.phrase = t.w3
  JOIN two p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN two q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3),
u AS (SELECT lang, phrase, a, l, r, score FROM c2 WHERE longest IS NULL OR 100 * longest < 50 * a
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, least(s1, s2) FROM c3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank FROM u)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""

MERKLE = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT *, coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, crc),
e AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM d),
f AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS altered FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM f),
t AS (SELECT lang, 0 AS level, rank AS i, leaf AS h, n FROM l
  UNION ALL SELECT lang, max(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY lang, i // 8),
s AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
c AS (SELECT 0 AS level, rank AS i, subroot AS h, n FROM s
  UNION ALL SELECT max(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM c WHERE n > 1 GROUP BY i // 8),
way AS (SELECT lang, level, i, (SELECT coalesce(string_agg(y.h, '' ORDER BY y.i), '') FROM t y WHERE y.lang IS NOT DISTINCT FROM x.lang AND y.level = x.level AND y.i // 8 = x.i // 8 AND y.i < x.i) AS b,
    (SELECT coalesce(string_agg(y.h, '' ORDER BY y.i), '') FROM t y WHERE y.lang IS NOT DISTINCT FROM x.lang AND y.level = x.level AND y.i // 8 = x.i // 8 AND y.i > x.i) AS a FROM t x WHERE n > 1),
top AS (SELECT level, i, (SELECT coalesce(string_agg(y.h, '' ORDER BY y.i), '') FROM c y WHERE y.level = x.level AND y.i // 8 = x.i // 8 AND y.i < x.i) AS b,
    (SELECT coalesce(string_agg(y.h, '' ORDER BY y.i), '') FROM c y WHERE y.level = x.level AND y.i // 8 = x.i // 8 AND y.i > x.i) AS a FROM c x WHERE n > 1),
up AS (SELECT l.lang, l.rank AS leaf_rank, 0 AS level, l.rank AS i, altered AS h, '' AS proof, false AS crown FROM l
  UNION ALL SELECT u.lang, u.leaf_rank, CASE WHEN w.level IS NULL AND NOT u.crown THEN 0 ELSE u.level + 1 END,
    CASE WHEN w.level IS NOT NULL THEN u.i // 8 WHEN NOT u.crown THEN s.rank ELSE u.i // 8 END,
    CASE WHEN w.level IS NOT NULL THEN sha256(w.b || u.h || w.a) WHEN NOT u.crown THEN u.h ELSE sha256(k.b || u.h || k.a) END,
    CASE WHEN w.level IS NOT NULL THEN u.proof || w.b || w.a WHEN NOT u.crown THEN u.proof ELSE u.proof || k.b || k.a END,
    w.level IS NULL
  FROM up u LEFT JOIN way w ON NOT u.crown AND w.lang IS NOT DISTINCT FROM u.lang AND w.level = u.level AND w.i = u.i
  JOIN s ON s.lang IS NOT DISTINCT FROM u.lang LEFT JOIN top k ON u.crown AND k.level = u.level AND k.i = u.i
  WHERE NOT u.crown OR k.level IS NOT NULL),
fin AS (SELECT lang, leaf_rank, arg_max(h, level) AS folded, arg_max(proof, level) AS proof FROM up WHERE crown GROUP BY lang, leaf_rank),
root AS (SELECT h AS root FROM c WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN fin ON fin.lang IS NOT DISTINCT FROM l.lang AND fin.leaf_rank = l.rank JOIN s ON s.lang IS NOT DISTINCT FROM l.lang, root
"""
