"""DuckDB SQL of the queries that SQL can express, over the same tables."""

SQL: dict[str, str] = {}

SQL["op3_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run
  FROM d, unnest(range(1, greatest(len(w) - 11, 1))) AS t(i)),
f AS (SELECT run, min(doc_id) AS first_doc FROM s GROUP BY run),
hit AS (SELECT s.doc_id, s.i FROM s JOIN f USING (run) WHERE f.first_doc < s.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(range(0, 13)) AS t(k)),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

SQL["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN link ON link.x = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op9_pivot_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT x, count(*) AS n FROM link GROUP BY 1),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, y FROM reach JOIN link ON link.x = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.x = c.vec_id
"""

# base32 of 20 bytes: 32 groups of five bits
SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1)),
    'string_agg', '') AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM b GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (payload_digest)
"""

SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS nth
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.nth <= 5
    AND 50 * CAST(p.score AS HUGEINT) <= 100 * CAST(s.score AS HUGEINT)
    AND 100 * CAST(s.score AS HUGEINT) <= 95 * CAST(p.score AS HUGEINT))
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= 3
"""

SQL["op12_phrase_collocations"] = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM p, unnest([1, 2, 3, 4]) AS x(m), unnest(range(1, greatest(len(w) - m + 2, 1))) AS y(i)
  GROUP BY 1, 2, 3 HAVING count(*) >= 30),
k AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE m >= 2),
cut AS (
  SELECT k.lang, k.phrase, k.m, k.f AS a, l.f AS l, r.f AS r,
    CAST((CAST(2000000 AS HUGEINT) * k.f) // (l.f + r.f) AS BIGINT) AS score, i
  FROM k, unnest(range(1, k.m)) AS x(i)
  JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:i], ' ')
  JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[i + 1:], ' ')),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM cut) WHERE nth = 1),
held AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer
  FROM k, unnest(range(2, k.m)) AS x(s), unnest(range(1, k.m - s + 2)) AS y(i) GROUP BY 1, 2),
o AS (
  SELECT least.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least LEFT JOIN held USING (lang, phrase)
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

SQL["op13_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS run FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS x(i)),
again AS (SELECT rid, unnest(list(i)) AS i FROM win GROUP BY rid, run HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, unnest(range(0, 5)) AS x(j) GROUP BY 1),
base AS (
  SELECT d.rid, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed
  FROM d LEFT JOIN rep USING (rid)),
parts AS (SELECT *, list_transform(['[^aeiou]', '[^b-df-hj-np-tv-z]', '[^A-Z]', '[^0-9]', '[^\x20\x09-\x0D]', '[^.,;:!?''"()-]',
    '[^\x{00C0}-\x{023F}]', '[^\x{0080}-\x{00BF}\x{0240}-\x{10FFFF}]'],
    lambda c: length(regexp_replace(t, c, '', 'g'))) AS c FROM base),
cls AS (SELECT rid, lang, base_failed, length(t) AS chars, j,
    CASE WHEN j < 9 THEN c[j] ELSE length(t) - CAST(list_sum(c) AS BIGINT) END AS n
  FROM parts, unnest(range(1, 10)) AS x(j)),
word AS (SELECT rid, lang, base_failed, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM base),
total AS (SELECT lang, count(*) AS n_ref FROM word WHERE NOT base_failed GROUP BY 1 HAVING count(*) >= 1000),
top AS (SELECT * FROM (SELECT lang, word, count(*) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS nth FROM word WHERE NOT base_failed GROUP BY 1, 2) WHERE nth <= 50),
cref AS (SELECT lang, j, n / sum(n) OVER (PARTITION BY lang) AS q
  FROM (SELECT lang, j, sum(n) AS n FROM cls WHERE NOT base_failed GROUP BY 1, 2) SEMI JOIN total USING (lang)),
wref AS (
  SELECT lang, word, n / n_ref AS q FROM top JOIN total USING (lang) UNION ALL
  SELECT lang, NULL, (n_ref - sum(n)) / n_ref FROM top JOIN total USING (lang) GROUP BY lang, n_ref),
wcount AS (SELECT rid, top.word, count(*) AS n FROM word LEFT JOIN top USING (lang, word) GROUP BY 1, 2),
hist AS (
  SELECT rid, 'c' AS kind, n / chars AS p, q FROM cls JOIN cref USING (lang, j) WHERE chars > 0 UNION ALL
  SELECT base.rid, 'w', coalesce(wcount.n, 0) / n_words, q FROM base JOIN wref USING (lang)
  LEFT JOIN wcount ON wcount.rid = base.rid AND wcount.word IS NOT DISTINCT FROM wref.word WHERE n_words > 0),
js AS (
  SELECT rid, kind, round(sqrt(greatest(0, least(1, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))), 6) AS d
  FROM hist GROUP BY 1, 2),
o AS (SELECT base.*, coalesce(a.d, 0) AS char_distance, coalesce(b.d, 0) AS word_distance FROM base
  LEFT JOIN js a ON a.rid = base.rid AND a.kind = 'c' LEFT JOIN js b ON b.rid = base.rid AND b.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (length(t) >= 200 AND char_distance > 0.25) AND NOT (n_words >= 50 AND word_distance > 0.5) AS kept,
  char_distance, word_distance FROM o
"""
