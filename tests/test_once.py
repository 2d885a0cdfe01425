"""Costly steps run once: what finds names, what counts them, what hashes a word."""

import hashlib

import numpy as np

from lodestone.functions import ports
from lodestone.operators import chunking, edits, graph, ingest
from lodestone.operators.names import occurrences

ENTITY = "array<struct<id:string,name:string,count:int,importance:double>>"


def _seen(spark, rows):
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), n


def test_names_are_found_once(spark):
    names, n = _seen(spark, spark.createDataFrame([("ab",), ("c",)], "name string"))
    texts = spark.createDataFrame([("1", "ab ab c"), ("2", None)], "hash_id string, text string")
    assert sorted(map(tuple, occurrences(texts, names).collect())) == [("1", "ab", 2), ("1", "c", 1)] and n.value == 2


def test_names_of_lines_are_found_once(spark):
    lines, n = _seen(spark, spark.createDataFrame([("k", "f", ["Abcdef", "Bcdefg"]), ("k", "f", ["Abcdef"])], "source_key string, file_id string, names array<string>"))
    found = spark.createDataFrame([("h", "Cdefgh")], "hash_id string, name string")
    rows = spark.createDataFrame([("h", "k", "f")], "hash_id string, source_key string, file_id string")
    assert {r.name for r in ingest.entity_nodes(found, rows, lines).collect()} == {"Abcdef", "Bcdefg", "Cdefgh"} and n.value == 2


def test_edges_count_names_once(spark):
    rows = spark.createDataFrame([("p", "a b a", [("e1", "a", 1, 1.0), ("e2", "b", 1, 1.0)], "q"), ("q", "x", [], None)], f"hash_id string, text string, entities {ENTITY}, next_passage_id string")
    got = graph.edges(rows)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("max_by(") == 1
    one = {("p", "e1", 2 / 3), ("p", "e2", 1 / 3), ("p", "q", 1.0)}
    assert set(map(tuple, got.collect())) == one | {(b, a, w) for a, b, w in one}


def test_a_word_is_hashed_once(spark):
    ports._hashed_word.cache_clear()
    assert ports._hashed_word("w", 64) == ports._hashed_word("w", 64) and ports._hashed_word.cache_info().misses == 1
    v = np.zeros(64)
    for w in "one two one three".split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % 64] += 1.0 if h >> 63 else -1.0
    rows = spark.createDataFrame([(0, "One two one three"), (1, None)], "i int, t string").withColumn("v", ports.HashingEmbedder().encode("t")).orderBy("i").collect()
    assert rows[0].v == (v / np.linalg.norm(v)).astype(np.float32).tolist() and rows[1].v == [0.0] * 64


def test_pages_are_parsed_once(spark):
    pages, n = _seen(spark, spark.createDataFrame([("f", 1, "Alpha\nsome text that is long enough to stay here"), ("g", 1, "no title")], "file string, page long, text string"))
    toc = spark.createDataFrame([("f", 1, 1, "Alpha", 1, 2)], "file string, ord int, level int, title string, page int, last_page int")
    got = chunking.sections(toc, pages).orderBy("file").collect()
    assert [(r.file, r.text) for r in got] == [("f", "Alpha\nsome text that is long enough to stay here"), ("g", "no title")] and n.value == 2


def test_lines_of_no_titles_length_get_no_keys(spark, monkeypatch):
    held, near = [], edits.near_texts
    monkeypatch.setattr(edits, "near_texts", lambda a, h, *rest: held.extend(r.held for r in h.collect()) or near(a, h, *rest))
    lines = [("f", 1, i, "x" * n) for i, n in enumerate((2, 3, 5, 7, 8, 300))]
    found = chunking.title_lines(spark.createDataFrame([("f", 1, "xxxxx", 1, 2), ("f", 2, None, 2, 2)], "file string, ord int, title string, page int, last_page int"), spark.createDataFrame(lines, "file string, page int, line_no int, line string"))
    assert sorted(map(len, held)) == [3, 5, 7] and [(r["ord"], r.line_no) for r in found.collect()] == [(1, 1)]
