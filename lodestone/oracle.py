"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_P = """p AS (SELECT doc_id, lang, text, source AS file_id, ':' || source || '.txt:' || source AS source_key,
  'passage-' || md5(':' || source || '.txt:' || source || ':' || doc_id || ':' || text) AS hash_id FROM documents)"""
_NB = """nb AS (SELECT *, lag(hash_id) OVER w AS prev, lead(hash_id) OVER w AS next FROM p WINDOW w AS (PARTITION BY source_key ORDER BY doc_id, hash_id))"""
_M = """m0 AS (SELECT hash_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS name FROM p),
m AS (SELECT hash_id, name, count(*) AS count, 'entity-' || md5(replace(lower(name), 'ß', 'ss')) AS entity_id FROM m0 GROUP BY ALL),
mi AS (SELECT *, sum(count) OVER (PARTITION BY hash_id) AS total, ln(1 + count) / ln(1 + sum(count) OVER (PARTITION BY hash_id)) AS importance FROM m)"""
_S = """s0 AS (SELECT DISTINCT source_key, file_id, hash_id AS passage_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM p)),
s AS (SELECT *, 'sentence-' || md5(passage_id || ':' || line) AS hash_id, list_distinct(regexp_extract_all(line, '[A-Z][a-z]{5,}')) AS names FROM s0
  WHERE line <> '' AND len(regexp_extract_all(line, '[A-Z][a-z]{5,}')) > 0)"""
_E = """en AS (SELECT DISTINCT source_key, name FROM (SELECT source_key, name FROM m JOIN p USING (hash_id) UNION ALL SELECT source_key, unnest(names) FROM s) WHERE source_key IN (SELECT source_key FROM s)),
e AS (SELECT 'entity-node-' || md5(source_key || ':' || name) AS hash_id, 'entity-' || md5(replace(lower(name), 'ß', 'ss')) AS entity_id, name, source_key FROM en),
le AS (SELECT entity_id, min(hash_id) AS hash_id, arg_min(name, hash_id) AS name FROM e GROUP BY entity_id)"""
_Q = """q AS (SELECT item_id AS query_id, b.text, v.embedding::DOUBLE[] AS vec FROM benchmark b LEFT JOIN embeddings v ON v.vec_id = b.item_id)"""
_PV = """pv AS (SELECT p.*, v.embedding::DOUBLE[] AS vec FROM p JOIN embeddings v ON v.vec_id = p.doc_id)"""


_WORD = "\\p{N}+(?:[.,]\\p{N}+)+|[\\p{L}\\p{M}\\p{N}_]+(?:[''’][\\p{L}\\p{M}]+)*"


def _terms(field: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({field}), '([\\p{{Han}}\\p{{Hiragana}}])', ' \\1 ', 'g'), '{_WORD}')"


def _cos(a: str, b: str) -> str:
    return f"(1 + list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))) / 2"


def _top(name: str, rows: str, k: int, tie: str = "hash_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM ({rows})) WHERE rank <= {k})"


def _vec(name: str, k: int, where: str = "TRUE", raw: bool = False) -> str:
    score = "list_dot_product(pv.vec, q.vec)" if raw else _cos("pv.vec", "q.vec")
    return _top(name, f"SELECT query_id, hash_id, round({score}, 12) AS score FROM pv, q WHERE q.vec IS NOT NULL AND {where}", k)


def _bm(name: str, k: int, table: str = "p", field: str = "text", asked: str = "q", cut: bool = True) -> str:
    t = _terms(field)
    scored = f"SELECT query_id, hash_id, {'round(sum(x), 12)' if cut else 'sum(x)'} AS score FROM {name}_x GROUP BY ALL"
    parts = f"""{name}_d AS (SELECT hash_id, {t} AS w, len({t}) AS dl FROM {table}),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_d),
{name}_a AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms('text')}) AS term FROM {asked}) GROUP BY ALL),
{name}_t AS (SELECT term, hash_id, dl, count(*) AS tf FROM (SELECT hash_id, dl, unnest(w) AS term FROM {name}_d) SEMI JOIN {name}_a USING (term) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY term),
{name}_x AS (SELECT query_id, hash_id, qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS x
  FROM {name}_t JOIN {name}_f USING (term) JOIN {name}_a USING (term), {name}_n)"""
    return parts + ",\n" + (_top(name, scored, k) if cut else f"{name} AS ({scored})")


def _hyb(name: str, k: int, deep: int) -> str:
    return f"{_vec(name + '_v', deep)},\n{_bm(name + '_b', deep)},\n" + _top(
        name, f"SELECT query_id, hash_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, hash_id, rank FROM {name}_v UNION ALL SELECT query_id, hash_id, rank FROM {name}_b) GROUP BY ALL", k
    )


_EXP = _top("ex", "SELECT query_id, entity_id, round(sum(importance / rank), 12) AS score FROM hits JOIN mi USING (hash_id) GROUP BY ALL", 20, "entity_id")
_EP = """ep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hash_id) AS rank FROM (SELECT DISTINCT query_id, m.hash_id FROM ex JOIN m USING (entity_id))) WHERE rank <= 50)"""
_NE = """ne0 AS (SELECT query_id, unnest([prev, next]) AS hash_id, unnest([2 * rank, 2 * rank + 1]) AS o FROM (SELECT query_id, hash_id, rank FROM hits UNION ALL SELECT query_id, hash_id, 1000000000 + rank FROM ep) JOIN nb USING (hash_id)),
ne AS (SELECT query_id, hash_id, min(o) AS ord FROM ne0 WHERE hash_id IS NOT NULL AND (query_id, hash_id) NOT IN (SELECT (query_id, hash_id) FROM hits UNION ALL SELECT (query_id, hash_id) FROM ep) GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _fused(first: str) -> str:
    lists = """SELECT query_id, hash_id, round(sum(s), 12) AS score, max(base) AS base_score, max(ent) AS entity_expansion_score FROM (
    SELECT query_id, hash_id, 1.0::DOUBLE / (60 + rank) AS s, score AS base, NULL::DOUBLE AS ent FROM hits
    UNION ALL SELECT query_id, hash_id, 0.7::DOUBLE / (60 + rank), NULL, 1.0::DOUBLE FROM ep
    UNION ALL SELECT query_id, hash_id, 0.25::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY ord)), NULL, NULL FROM ne) GROUP BY ALL"""
    return _with(_P, _NB, _M, _Q, _PV, first, _EXP, _EP, _NE, _top("f", lists, 5)) + "SELECT query_id, rank, hash_id, round(score, 6) AS score, round(base_score, 6) AS base_score, entity_expansion_score FROM f"


_RANKED = "SELECT query_id, hash_id, round(score, 6) AS score, rank FROM t"
_BRIDGE = """rare AS (SELECT name FROM m GROUP BY name HAVING count(DISTINCT hash_id) BETWEEN 2 AND 3),
br AS (SELECT a.hash_id AS left_id, b.hash_id AS right_id, min(name) AS bridge FROM m a JOIN m b USING (name) SEMI JOIN rare USING (name) WHERE a.hash_id < b.hash_id GROUP BY ALL)"""
_UNIQUE = "u AS (SELECT name, min(hash_id) AS hash_id FROM m GROUP BY name HAVING count(DISTINCT hash_id) = 1)"
_PAGE = """pg AS (SELECT source AS file, doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN '1 ' || left(regexp_replace(text, '[^A-Za-z]', '', 'g'), 12) || chr(10) ELSE '' END || text AS text FROM documents),
ln0 AS (SELECT file, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM pg),
ln1 AS (SELECT file, page, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM ln0),
ln AS (SELECT *, length(line) BETWEEN 1 AND 20 AND NOT regexp_matches(line, '[^\\p{L}\\p{M}\\p{N}_\\s]$')
    AND (len(regexp_extract_all(line, '\\p{L}')) >= 0.5 * len(regexp_extract_all(line, '\\S')))
    AND NOT regexp_matches(line, '^[\\p{N}〇零一二三四五六七八九十百千万亿]+$') AND regexp_matches(left(line, 5), '[\\p{N}〇零一二三四五六七八九十百千万亿]') AS is_title
  FROM ln1 WHERE line <> '')"""
_HTML = """hp AS (SELECT page_id AS file, url, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?i)<(br|/p|/h[1-6]|/li|/tr|/div|/article|/nav|/title)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages)"""
_TOC = """toc AS (SELECT n_regionkey AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, n_name AS title, 1 + n_nationkey % 3 AS level FROM nation)"""
_REL = "rel AS (SELECT query_id, hash_id FROM q JOIN p ON contains(p.text, q.text))"
_SNIP = "sn AS (SELECT conv_id, turn, role, role || '-' || md5(text) AS hash_id FROM conversations)"
_ASKED = "asked AS (SELECT item_id AS query_id, ord, embedding::DOUBLE[] AS vec FROM (SELECT item_id, unnest([0, 1]) AS ord, unnest([item_id, item_id + 100]) AS vid FROM benchmark) JOIN embeddings ON vec_id = vid)"
_EV = "ev AS (SELECT le.*, embedding::DOUBLE[] AS vec FROM le JOIN embeddings ON vec_id = ('0x' || substr(entity_id, 8, 6))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings))"


def _seed(score: str, pick: str) -> str:
    return _with(_P, _M, _S, _E, _EV, _ASKED) + f"""SELECT query_id, entity_id, round({pick}, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, ord ORDER BY score DESC, hash_id) AS rn FROM (
    SELECT query_id, ord, entity_id, hash_id, round({score}, 12) AS score FROM asked, ev)) WHERE rn = 1 GROUP BY ALL"""


def _ppr(rounds: int) -> str:
    parts = [
        "g0 AS (SELECT 'n' || c_nationkey AS src, c_mktsegment AS dst, count(*)::DOUBLE AS w FROM customer GROUP BY ALL)",
        "g AS (SELECT * FROM g0 UNION ALL SELECT dst, src, w FROM g0)",
        "fl AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM g)",
        "nd AS (SELECT DISTINCT src AS node FROM g)",
        "rs AS (SELECT node, CASE node WHEN 'n0' THEN 2.0::DOUBLE WHEN 'BUILDING' THEN 1.0 ELSE 0 END AS r FROM nd)",
        "t AS (SELECT node, r / sum(r) OVER () AS t FROM rs)",
        "x0 AS (SELECT node, t AS score FROM t)",
    ]
    for i in range(rounds):
        parts.append(f"x{i + 1} AS (SELECT t.node, 0.5 * t.t + 0.5 * coalesce(sum(x.score * fl.share), 0) AS score FROM t LEFT JOIN fl ON fl.dst = t.node LEFT JOIN x{i} x ON x.node = fl.src GROUP BY t.node, t.t)")
    return _with(*parts) + f"SELECT node, round(score, 6) AS score FROM x{rounds}"


_PCT = ", ".join(f"round(max(CASE WHEN i = least(n - 1, floor(n * {p})::BIGINT) THEN value END), 6) AS p{int(100 * p)}" for p in (0.5, 0.95, 0.99))

ORACLE_SQL: dict[str, str] = {
    "passage_ids": _with(_P) + "SELECT doc_id, source_key, hash_id FROM p",
    "passage_neighbors": _with(_P, _NB) + "SELECT hash_id, prev AS previous_passage_id, next AS next_passage_id FROM nb",
    "entity_mentions": _with(_P, _M) + "SELECT hash_id, name, entity_id, count FROM m",
    "entity_importance": _with(_P, _M) + "SELECT hash_id, name, count, total::BIGINT AS total, round(importance, 6) AS importance FROM mi",
    "passage_metadata": _with(_P, _M) + "SELECT p.hash_id, coalesce(string_agg(entity_id, ',' ORDER BY name), '') AS entity_ids, coalesce(string_agg(name, ',' ORDER BY name), '') AS entity_names FROM p LEFT JOIN m USING (hash_id) GROUP BY p.hash_id",
    "entity_nodes": _with(_P, _M, _S, _E) + "SELECT hash_id, entity_id, name, source_key FROM e",
    "sentence_nodes": _with(_P, _S) + "SELECT hash_id, passage_id, len(names)::BIGINT AS n_entities, array_to_string(list_sort(list_transform(names, lambda x: 'entity-' || md5(lower(x)))), ',') AS entity_ids FROM s",
    "entity_collapse": _with(_P, _M, _S, _E) + "SELECT entity_id, hash_id, name FROM le",
    "entity_df_unique": _with(_P, _M) + "SELECT name, count(DISTINCT hash_id) AS df, count(DISTINCT hash_id) = 1 AS is_unique FROM m GROUP BY name",
    "write_statistics": _with(_P, _M, _S, _E) + "SELECT (SELECT count(*) FROM p) AS new_passages, (SELECT count(DISTINCT entity_id) FROM e) AS new_entities, 0::BIGINT AS failed_passages, FALSE AS skipped",
    "filter_terms_array": _with(_P, _M) + """SELECT hash_id, lang, file_id, 1.0::DOUBLE AS score FROM p WHERE lang IN ('en', 'de') AND file_id IN ('src0', 'src3', 'src7')
  AND hash_id IN (SELECT hash_id FROM m WHERE name IN ('Therhean', 'Anthin', 'Thereon', 'Ination', 'Ertion')) ORDER BY hash_id LIMIT 50""",
    "entity_passages_topn": _with(_P, _M, _S, _E) + "SELECT * FROM (SELECT entity_id, hash_id, row_number() OVER (PARTITION BY entity_id ORDER BY hash_id) AS rn FROM (SELECT DISTINCT entity_id, hash_id FROM m SEMI JOIN le USING (entity_id))) WHERE rn <= 5",
    "graph_nodes_bounded": _with(_P, _S) + "SELECT hash_id, passage_id FROM s WHERE file_id IN ('src1', 'src2') ORDER BY hash_id LIMIT 750",
    "vector_topk": _with(_P, _PV, _Q, _vec("t", 10)) + _RANKED,
    "vector_topk_cells": _with(_P, _PV, _Q, _vec("t", 10)) + _RANKED,
    "vector_topk_cells_filtered": _with(_P, _PV, _Q, _vec("t", 10, "lang = 'en'")) + _RANKED,
    "vector_topk_filtered": _with(_P, _PV, _Q, _vec("t", 10, "lang = 'en'")) + _RANKED,
    "dense_fallback": _with(_P, _PV, _Q, _vec("t", 5, raw=True)) + _RANKED,
    "bm25_topk": _with(_P, _Q, _bm("t", 10)) + _RANKED,
    "bm25_topk_stored": _with(_P, _Q, _bm("t", 10)) + _RANKED,
    "hybrid_retrieve": _with(_P, _PV, _Q, _hyb("t", 5, 20)) + "SELECT query_id, rank, hash_id, round(score, 6) AS score FROM t",
    "neighbor_expand": _with(_P, _NB, _M, _Q, _bm("hits", 20), _EXP, _EP, _NE) + "SELECT query_id, hash_id, ord FROM ne",
    "select_expansion_entities": _with(_P, _M, _Q, _bm("hits", 20), _EXP) + "SELECT query_id, entity_id, round(score, 6) AS score, rank FROM ex",
    "expand_entity_passages": _with(_P, _M, _Q, _bm("hits", 20), _EXP, _EP) + "SELECT query_id, hash_id, rank FROM ep",
    "retrieve_vector": _fused(_vec("hits", 20)),
    "retrieve_bm25": _fused(_bm("hits", 20)),
    "retrieve_hybrid": _fused(_hyb("hits", 20, 80)),
    "dense_minmax": _with(_P, _Q)
    + """SELECT query_id, hash_id, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0 END, 6) AS dense FROM (
  SELECT *, min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM (
    SELECT query_id, hash_id, coalesce(list_dot_product(v.embedding::DOUBLE[], q.vec), 0) AS raw FROM q, p LEFT JOIN embeddings v ON v.vec_id = p.doc_id WHERE q.vec IS NOT NULL))""",
    "graph_edges": _with(_P, _NB, _M)
    + """SELECT src, dst, round(w, 6) AS w FROM (SELECT hash_id AS src, entity_id AS dst, w FROM ed UNION ALL SELECT entity_id, hash_id, w FROM ed UNION ALL SELECT hash_id, next, 1.0 FROM nb WHERE next IS NOT NULL UNION ALL SELECT next, hash_id, 1.0 FROM nb WHERE next IS NOT NULL)""".replace(
        " FROM ed", " FROM (SELECT hash_id, entity_id, n::DOUBLE / sum(n) OVER (PARTITION BY hash_id) AS w FROM (SELECT hash_id, entity_id, arg_max((length(text) - length(replace(text, name, ''))) // length(name), name) AS n FROM m JOIN p USING (hash_id) GROUP BY ALL))"
    ),
    "passage_bonus": _with(_P, "a AS (SELECT n_nationkey::BIGINT AS query_id, unnest([n_name, 'thin', 'ertion']) AS name, unnest([1, 2, 3]) AS tier FROM nation)")
    + """SELECT * FROM (SELECT query_id, hash_id, round(sum(1.0 / tier * ln(1 + (length(lower(text)) - length(replace(lower(text), lower(name), ''))) / length(name)) / tier), 6) AS bonus FROM p, a
  WHERE contains(lower(text), lower(name)) GROUP BY ALL) WHERE bonus > 0""",
    "ppr_fixed_iters": _ppr(3),
    "seed_match_full": _seed("list_dot_product(asked.vec, ev.vec)", "arg_max(score, ord)"),
    "seed_match_local": _seed(_cos("asked.vec", "ev.vec"), "max(score)"),
    "candidate_merge": _with(_P, _PV, _Q, _bm("a", 8), _vec("b", 8))
    + """SELECT query_id, hash_id, ord FROM (SELECT query_id, hash_id, row_number() OVER (PARTITION BY query_id ORDER BY o, hash_id) AS ord FROM (
  SELECT query_id, hash_id, min(o) AS o FROM (SELECT query_id, hash_id, rank AS o FROM a UNION ALL SELECT query_id, hash_id, 1000 + rank FROM b) GROUP BY ALL)) WHERE ord <= 12""",
    "name_occurrences": _with(_P, _M, _S, _E) + "SELECT hash_id, name, (length(text) - length(replace(text, name, ''))) // length(name) AS n FROM p, (SELECT DISTINCT name FROM le) WHERE contains(text, name)",
    "multi_kb_scan": _with(_P, _SNIP) + "SELECT kb, type, count(*) AS n, min(hash_id) AS first_id FROM (SELECT 'docs' AS kb, 'passage' AS type, hash_id FROM p UNION ALL SELECT 'dialog', role, hash_id FROM sn) GROUP BY ALL",
    "upsert_merge": _with(_SNIP)
    + """, new AS (SELECT hash_id, arg_max(conv_id, (conv_id, turn)) AS conv_id, arg_max(turn, (conv_id, turn)) AS turn FROM sn WHERE turn > 0 GROUP BY hash_id)
SELECT * FROM new UNION ALL SELECT hash_id, min(conv_id), 0 FROM sn WHERE turn = 0 AND hash_id NOT IN (SELECT hash_id FROM new) GROUP BY hash_id""",
    "lookup_by_ids": _with(_P) + "SELECT doc_id, hash_id FROM p WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "delete_by_ids": _with(_P) + "SELECT doc_id, hash_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "delete_by_file": "SELECT source AS file_id, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src4') GROUP BY source",
    "snippet_upsert_ids": _with(_SNIP) + "SELECT conv_id, turn, hash_id FROM sn",
    "segment_projection": "SELECT source || '.txt' AS file_name, doc_id AS segment_id, md5(text) AS ori_md5, length(text) AS n_chars FROM documents",
    "object_key_validate": """SELECT page_id, key, ok AS valid, ok AND NOT contains(key, '/') AS valid_bucket FROM (SELECT *,
  len(list_filter(string_split(key, '/'), lambda x: x IN ('', '.', '..'))) = 0 AND NOT regexp_matches(key, '[<>:"\\\\|?*\\x00-\\x1f]') AS ok FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS key FROM pages))""",
    "title_lines": _with(_PAGE) + "SELECT file, page, line_no, line FROM ln WHERE is_title",
    "chunk_by_title": _with(
        _PAGE,
        "ck AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY file ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM ln)",
        "ct AS (SELECT file, chunk, coalesce(max(CASE WHEN is_title THEN line END), '无标题内容') AS title, max(page) AS page, string_agg(CASE WHEN is_title THEN '# ' ELSE '' END || line, chr(10) ORDER BY page, line_no) AS text FROM ck GROUP BY ALL)",
    )
    + "SELECT file, chunk, title, page, length(text) AS n_chars, md5(text) AS text_md5 FROM ct",
    "bm25_multi_field": _with(
        _HTML,
        _Q,
        "ws AS (SELECT file::VARCHAR AS hash_id, text, url FROM hp)",
        "aq AS (SELECT query_id, concat_ws(' ', text, 'http org example page') AS text FROM q)",
        _bm("a", 10, "ws", "text", "aq", cut=False),
        _bm("b", 10, "ws", "url", "aq", cut=False),
        _top("t", "SELECT query_id, hash_id, round(max(score), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL", 10),
    )
    + _RANKED,
    "page_chunks": _with(
        _HTML,
        "pg AS (SELECT file, 1::BIGINT AS page, text FROM hp)",
        _PAGE[_PAGE.index("ln0 AS") :],
        "ck AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY file ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM ln)",
    )
    + """SELECT file, row_number() OVER (PARTITION BY file ORDER BY chunk) AS segment_id, coalesce(max(CASE WHEN is_title THEN line END), '无标题内容') AS title,
  (sum(length(line) + CASE WHEN is_title THEN 3 ELSE 1 END) - 1)::BIGINT AS n_chars FROM ck GROUP BY file, chunk""",
    "merge_small_chunks": _with(
        "RECURSIVE " + _PAGE,
        "ck AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY file ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM ln)",
        "ct AS (SELECT file, chunk, coalesce(max(CASE WHEN is_title THEN line END), '无标题内容') AS title, max(page) AS page, sum(length(line) + CASE WHEN is_title THEN 3 ELSE 1 END) - 1 AS size FROM ck GROUP BY ALL)",
        "cn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunk) AS i, count(*) OVER (PARTITION BY file) > 10 AS packed FROM ct)",
        """walk AS (SELECT file, i, size AS held, 0::BIGINT AS pack FROM cn WHERE i = 1
  UNION ALL SELECT w.file, c.i, CASE WHEN packed AND held + size <= 2000 THEN held + 1 + size ELSE size END, CASE WHEN packed AND held + size <= 2000 THEN pack ELSE pack + 1 END FROM walk w JOIN cn c ON c.file = w.file AND c.i = w.i + 1)""",
    )
    + "SELECT file, pack AS chunk, arg_min(title, i) AS title, arg_min(page, i) AS page, count(*) AS parts, (sum(size) + count(*) - 1)::BIGINT AS n_chars FROM walk JOIN cn USING (file, i) GROUP BY file, pack",
    "toc_page_span": _with(_TOC) + "SELECT file::BIGINT AS file, ord, 2 * ord AS page, coalesce(2 * lead(ord) OVER (PARTITION BY file ORDER BY ord), 99) AS end_page, title FROM toc",
    "toc_parent_titles": _with(
        "RECURSIVE " + _TOC,
        "up AS (SELECT c.file, c.ord, max(a.ord) AS above FROM toc c JOIN toc a ON a.file = c.file AND a.ord < c.ord AND a.level < c.level GROUP BY ALL)",
        "walk AS (SELECT file, ord, ord AS at, '' AS parents FROM toc UNION ALL SELECT w.file, w.ord, up.above, t.title || CASE WHEN w.parents = '' THEN '' ELSE '/' || w.parents END FROM walk w JOIN up ON up.file = w.file AND up.ord = w.at JOIN toc t ON t.file = w.file AND t.ord = up.above)",
    )
    + "SELECT file::BIGINT AS file, ord, title, arg_max(parents, length(parents)) AS parents FROM walk JOIN toc USING (file, ord) GROUP BY ALL",
    "toc_sections": _with(
        "RECURSIVE " + _HTML,
        "st AS (SELECT *, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site FROM pages)",
        "pl AS (SELECT site AS file, file AS page, regexp_replace(text, '[^ -~\\n]', '?', 'g') AS text FROM hp JOIN st ON page_id = file)",
        "l0 AS (SELECT file, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM pl)",
        "ls AS MATERIALIZED (SELECT file, page, line_no, trim(raw, ' ') AS line FROM l0 WHERE trim(raw, ' ') <> '')",
        "h AS (SELECT site AS file, page_id AS ord, 1 + page_id % 3 AS level, trim(regexp_replace(replace(regexp_extract(html, '<h1>([^<]*)', 1), '&amp;', '&'), '[^ -~\\n]', '?', 'g'), ' ') AS t FROM st)",
        "toc AS MATERIALIZED (SELECT file, ord, level, CASE WHEN ord % 2 = 0 THEN substr(t, 2) ELSE t END AS title, ord AS page, coalesce(lead(ord) OVER (PARTITION BY file ORDER BY ord), 1099511627776) AS end_page FROM h WHERE t <> '')",
        "hit AS (SELECT c.file, c.ord, min(struct_pack(p := ls.page, n := ls.line_no)) AS pos FROM toc c JOIN ls ON ls.file = c.file AND ls.page BETWEEN c.page AND c.end_page AND levenshtein(ls.line, c.title) <= 2 GROUP BY ALL)",
        "cut AS (SELECT *, lead(pos) OVER (PARTITION BY file ORDER BY ord) AS til FROM hit)",
        "up AS (SELECT c.file, c.ord, max(a.ord) AS above FROM toc c JOIN toc a ON a.file = c.file AND a.ord < c.ord AND a.level < c.level GROUP BY ALL)",
        "walk AS (SELECT file, ord, ord AS at, '' AS parents FROM toc UNION ALL SELECT w.file, w.ord, up.above, t.title || chr(10) || w.parents FROM walk w JOIN up ON up.file = w.file AND up.ord = w.at JOIN toc t ON t.file = w.file AND t.ord = up.above)",
        "par AS (SELECT file, ord, arg_max(parents, length(parents)) AS parents FROM walk GROUP BY ALL)",
        "sec AS (SELECT c.file, c.ord, string_agg(line, chr(10) ORDER BY ls.page, ls.line_no) AS body FROM cut c JOIN ls ON ls.file = c.file AND struct_pack(p := ls.page, n := ls.line_no) >= pos AND (til IS NULL OR struct_pack(p := ls.page, n := ls.line_no) < til) GROUP BY ALL)",
        "full_text AS (SELECT file, ord, title, parents || body AS text FROM sec JOIN par USING (file, ord) JOIN toc USING (file, ord))",
    )
    + "SELECT file, ord, title, length(text) AS n_chars, md5(text) AS text_md5 FROM full_text WHERE length(text) > 30",
    "fuzzy_title_match": """WITH w AS (SELECT word, row_number() OVER (ORDER BY word) AS n FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part))
SELECT a.n AS ord, a.word AS title, min(b.n) AS line_no FROM w a JOIN w b ON levenshtein(a.word, b.word) <= 2 GROUP BY ALL""",
    "recall_at_k": _with(_P, _Q, _bm("t", 10), _REL)
    + """, g AS (SELECT k, query_id, count(*) AS want, count(t.rank) AS got FROM (SELECT unnest([1, 3, 5, 10]) AS k), rel LEFT JOIN t ON t.query_id = rel.query_id AND t.hash_id = rel.hash_id AND t.rank <= k GROUP BY k, rel.query_id)
SELECT k::BIGINT AS k, count(*) AS questions, round(avg((got > 0)::INT), 6) AS any_at_k, round(avg(got / want), 6) AS passage_recall_at_k, round(avg((got = want)::INT), 6) AS all_at_k FROM g GROUP BY k""".replace("SELECT k, query_id", "SELECT k, rel.query_id"),
    "target_positions": _with(_P, _Q, _bm("t", 10), _REL) + "SELECT rel.query_id, rel.hash_id, t.rank FROM rel LEFT JOIN t USING (query_id, hash_id)",
    "single_target_cases": _with(_P, _M, _UNIQUE) + "SELECT hash_id, min(name) AS name FROM u GROUP BY hash_id",
    "weak_entity_labels": _with(_P, _M, "u AS (SELECT name, min(hash_id) AS hash_id FROM m WHERE length(name) BETWEEN 6 AND 16 GROUP BY name HAVING count(DISTINCT hash_id) = 1)") + "SELECT hash_id, min(name) AS name FROM u GROUP BY hash_id",
    "templated_cases": _with(_P, _M, _UNIQUE) + "SELECT replace(x, '{}', name) AS question, name, hash_id FROM u, (SELECT unnest(['What is {}?', 'Where does {} occur?']) AS x)",
    "multihop_pairs": _with(_P, _M, _BRIDGE)
    + """SELECT * FROM (SELECT left_id, right_id, bridge,
  (SELECT min(name) FROM m WHERE hash_id = left_id AND name NOT IN (SELECT name FROM m WHERE hash_id = right_id)) AS left_only,
  (SELECT min(name) FROM m WHERE hash_id = right_id AND name NOT IN (SELECT name FROM m WHERE hash_id = left_id)) AS right_only FROM br) WHERE left_only IS NOT NULL AND right_only IS NOT NULL""",
    "round_robin_sample": _with(_P, _M, _BRIDGE) + "SELECT bridge, left_id, right_id, row_number() OVER (PARTITION BY bridge ORDER BY left_id, right_id) AS turn FROM br",
    "latency_percentiles": f"""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(median(value), 6) AS median, {_PCT} FROM x GROUP BY event_type""",
    "ordered_distinct_users": "SELECT user_id, min(event_id) AS ord FROM events GROUP BY user_id",
    "vector_self_dot": "SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM embeddings",
}
