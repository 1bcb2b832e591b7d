"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), five AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM five) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid
), base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d) AS d
  LEFT JOIN covered AS c USING (rid)
), failed AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base
), hosts AS (
  SELECT source AS host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM failed WHERE source IS NOT NULL GROUP BY 1
), moments AS (
  SELECT sum(f) / sum(n) AS m, sum(f * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2 AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM moments
), rates AS (
  SELECT host, (f + m * k) / (n + k) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS shrunk_rate,
  (NOT base_failed AND coalesce(rate <= 0.8, true)) AS kept
FROM failed LEFT JOIN rates ON source = host
"""

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0 * source_size / [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS fullness FROM s
), ranked AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY fullness, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped_size,
    sum(weight) OVER (ORDER BY fullness, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight,
    1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget
  FROM weighted
), level AS (
  SELECT arg_min((budget - 2::DOUBLE * capped_size) / open_weight, fullness) AS level FROM ranked WHERE (budget - 2::DOUBLE * capped_size) / open_weight <= fullness
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM ranked, level
), line AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size)::BIGINT AS upto
  FROM d JOIN targets AS t ON d.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT (p * source_size + upto) / target AS finish,
    sum(size) OVER (ORDER BY (p * source_size + upto) / target, source NULLS LAST, place, doc_id, size, p) AS queued
  FROM line, range(2) AS r(p) WHERE size > 0 AND target > 0
), cut AS (
  SELECT max(finish) AS cut FROM queue WHERE queued <= (SELECT round(sum(target)) FROM targets)
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN upto / target <= cut THEN size ELSE 0 END + CASE WHEN (source_size + upto) / target <= cut THEN size ELSE 0 END)::BIGINT AS taken
FROM line, cut
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
      ELSE list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) END) AS g FROM d)
), sizes AS (
  SELECT doc_id, count(g) AS n FROM d LEFT JOIN grams USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT sizes.doc_id, n::BIGINT AS n_shingles, min(y) AS component_id FROM sizes JOIN reach ON sizes.doc_id = x GROUP BY sizes.doc_id, n
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(h), 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""

_SHARE = "1 + (1000000000 * (n::HUGEINT + 2)) // (total::HUGEINT + 2 * kept)"

SOURCE_AUDIT = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
), w AS (
  SELECT rid, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT rid, lang, source, unnest(found) AS t FROM d)
), v AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10
), langs AS (
  SELECT l.lang, count(v.term) AS kept FROM (SELECT DISTINCT lang FROM d) AS l LEFT JOIN v USING (lang) GROUP BY l.lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, kept, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) AS s JOIN langs USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, n, ({_SHARE})::HUGEINT AS p
  FROM (SELECT g.*, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term))
), q AS (
  SELECT lang, term, ({_SHARE})::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN langs USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY ALL) USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source AS one, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) AS s ON s.lang = a.lang AND s.one = a.source AND s.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""

# crc32 of a number's decimal text, byte by byte and bit by bit
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), "
    "lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
)

PREFIX_TRIE = rf"""
WITH t AS (
  SELECT conv_id, md5(length(r) || ':' || r || x) AS id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)
), r AS (
  SELECT c, 0 AS own, i, id, w FROM c JOIN t ON t.conv_id = c - c % 20 AND i <= h
  UNION ALL SELECT c, 1, i, id, w FROM c JOIN t ON t.conv_id = c AND i > h
), s AS (
  SELECT c.c, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws
  FROM c LEFT JOIN (SELECT c, list(id ORDER BY own, i) AS ids, list(w ORDER BY own, i) AS ws FROM r GROUP BY c) AS g ON g.c = c.c
), n AS (
  SELECT p, len(p) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ids) = len(p)), '')) AS ends_sha256
  FROM (SELECT c, ids, list_slice(ids, 1, d) AS p, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM s, unnest(range(len(ids) + 1)) AS u(d))
  GROUP BY p
), k AS (
  SELECT p[:-2] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), e AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)
), under AS (
  SELECT list_slice(p, 1, a) AS p, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT e.*, unnest(range(depth + 1)) AS a FROM e) GROUP BY 1
)
SELECT e.conv_id, e.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
FROM e JOIN under USING (p) LEFT JOIN n AS up ON e.depth > 0 AND up.p = e.p[:-2]
"""
