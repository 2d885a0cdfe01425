"""DuckDB SQL over the same tables, for the operators that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Metrics and verdict of the production quality rules.
QUALITY_RULES = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format('text')} AS w,
         CASE WHEN text IS NULL THEN [] ELSE list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') END AS ls
  FROM documents),
rows AS (SELECT row_number() OVER () AS rid, * FROM base),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM rows)),
marked AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c >= 2),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM marked) GROUP BY rid),
m AS (
  SELECT doc_id, t, len(ls) AS n_lines, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM rows LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND n_symbols <= 0.05 * word_chars
       AND n_repeat_words <= 0.4 * n_words
       AND n_dup_lines <= 0.5 * n_lines
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND length(regexp_replace(t, '[^A-Z]+', '', 'g')) <= 0.4 * word_chars
       AND length(t) - length(replace(t, '!', '')) <= 0.04 * word_chars
       AND length(regexp_replace(t, '[^0-9]+', '', 'g')) <= 0.3 * word_chars AS kept
FROM b
"""

#: Every window of 50 words against the least document that has it.
SUBSTRING_DEDUP = f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM rows)),
late AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE doc_id > f),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM late)),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM rows),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY word.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM rows LEFT JOIN kept USING (rid)
"""

#: Every anchor against every row.
HARD_NEGATIVES = """
WITH rows AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
              FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
met AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
        FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
pos AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, rid AS positive FROM met WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos p JOIN met USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

#: Every rule against every URL.
URL_FILTERS = """
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
split AS (SELECT row_number() OVER () AS rid, page_id,
                 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split LEFT JOIN best USING (rid)
"""

#: Near words share the shorter one, or what is left when one place of both goes; the checksum is built from its polynomial.
SPELLING = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM each),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS k FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cuts a JOIN cuts b ON a.i = b.i AND a.k = b.k AND a.word < b.word
          UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cuts c ON w.word = c.k),
near AS (SELECT a AS word, an AS n, b AS o, bn AS o_n FROM pairs UNION SELECT b, bn, a, an FROM pairs),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
forms AS (SELECT word, o AS form, o_n AS form_n FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY o_n DESC, o) = 1) WHERE o_n >= 2 * n),
way AS (SELECT word, form AS root, 1 AS d FROM forms UNION ALL SELECT way.word, f.form, d + 1 FROM way JOIN forms f ON way.root = f.word)
SELECT word, form, coalesce((SELECT arg_max(root, d) FROM way WHERE way.word = words.word), word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
"""

ORACLE_SQL = {
    "op2_quality_rules": QUALITY_RULES,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_url_filters": URL_FILTERS,
    "op13_spelling_variants": SPELLING,
}
