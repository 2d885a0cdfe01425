"""Indexes that are stored beside a base: vector cells and postings, against whole scans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.ports import HashingEmbedder
from lodestone.operators import nearest, postings, search
from lodestone.operators.cells import VectorCells
from lodestone.operators.postings import Postings
from lodestone.operators.store import NodeStore
from lodestone.plans.engine import Engine
from lodestone.schema import SearchQuery


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def ranked(df):
    return sorted((r.query_id, r["rank"], r.hash_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors, one of them very common, and rows that have none."""
    random = np.random.default_rng(4)
    centres = random.normal(size=(12, 8))
    x = centres[random.integers(0, 12, 900)] + random.normal(size=(900, 8)) * 0.2
    x[600:] = x[0]
    rows = [(f"h{i:04d}", "en" if i % 3 else "de", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("n0", "en", None), ("n1", "en", []), ("n2", "en", [0.0] * 8), ("n3", "en", [1.0, 2.0]), ("n4", "en", [float("nan")] * 8)]
    points = spark.createDataFrame(rows, "hash_id string, lang string, vector array<float>").repartition(5)
    asked = [(i, [float(v) for v in centres[i] + random.normal(size=8) * 0.1]) for i in range(12)] + [(90, [0.0] * 8), (91, None), (92, [float(v) for v in x[0]])]
    return points, spark.createDataFrame(asked, "query_id long, vector array<float>")


def whole(points, asked, k, where="true"):
    p = [(r.hash_id, np.array(r.vector, float)) for r in points.filter(where).collect() if r.vector and len(r.vector) == 8 and np.isfinite(r.vector).all() and np.any(r.vector)]
    out = []
    for q in asked.collect():
        if q.vector and np.any(q.vector):
            v = np.array(q.vector, float)
            met = sorted((-round((1 + x @ v / np.sqrt((x @ x) * (v @ v))) / 2, 12), h) for h, x in p)[:k]
            out += [(q.query_id, i, h, round(-s, 9)) for i, (s, h) in enumerate(met, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [None, 1, 5])
def test_cells_are_exact_when_asked(spark, vectors, tmp_path, cells):
    points, asked = vectors
    index = VectorCells.build(points, f"file://{tmp_path}/i", cells=cells)
    assert ranked(index.search(asked, 7, None)) == whole(points, asked, 7)
    assert ranked(index.search(asked, 7, None, F.col("lang") == "de")) == whole(points, asked, 7, "lang = 'de'")
    assert ranked(index.search(asked, 7, 10_000)) == whole(points, asked, 7)
    assert ranked(index.search(asked, 1000, None, F.col("lang") == "fr")) == []
    assert sum(index.sizes) == 900


def test_cells_recall_and_pruned_folders(spark, vectors, tmp_path):
    points, asked = vectors
    index = VectorCells.build(points.filter("hash_id < 'h0600' or hash_id >= 'n'"), f"file://{tmp_path}/i")
    found, want = ranked(index.search(asked, 5, 60)), whole(points.filter("hash_id < 'h0600'"), asked, 5)
    assert len({x[:1] + x[2:3] for x in found} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)
    one = plan(index.search(asked.filter("query_id = 3"), 5, 20))
    picked = re.search(r"PartitionFilters: \[.*?cell#\d+ (?:IN \(([\d,]*)\)|= (\d+))", one)
    assert picked and len((picked[1] or picked[2]).split(",")) < len(index.numbers) / 3
    assert "CartesianProduct" not in one and "NestedLoop" not in one


def test_cells_in_blocks_of_questions(spark, vectors, tmp_path, monkeypatch):
    points, asked = vectors
    index = VectorCells.build(points, f"file://{tmp_path}/i")
    monkeypatch.setattr(nearest, "SENT_NUMBERS", 24)
    assert ranked(index.search(asked, 3, None)) == whole(points, asked, 3)
    assert ranked(search.vector_topk(points, asked, 3)) == whole(points, asked, 3)
    assert "CartesianProduct" not in plan(search.vector_topk(points, asked, 3))


def test_no_vectors_no_cells(spark, vectors, tmp_path):
    with pytest.raises(ValueError, match="no vector"):
        VectorCells.build(vectors[0].filter("vector IS NULL"), f"file://{tmp_path}/i")
    index = VectorCells.build(vectors[0].limit(40), f"file://{tmp_path}/j")
    assert index.search(vectors[1].limit(0), 3).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<float>")
    assert index.search(odd, 3).count() == 0


def test_other_lengths_are_no_points(spark):
    points = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0]), ("c", [1.0, 0.0])], "hash_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, vector array<float>")
    assert [r.hash_id for r in search.vector_topk(points, asked, 5).collect()] == ["c"]
    assert {r.hash_id: r.dense for r in nearest.scaled(points, asked).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_engine_reads_its_cells_until_the_base_changes(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e", HashingEmbedder(16))
    rows = spark.createDataFrame([(f"Alpha Bravo{i} text {i % 7}", f"f{i % 3}", i) for i in range(60)], "text string, file_id string, segment_id long")
    segments = rows.withColumns({c: F.lit(None).cast("string") for c in ("file_name", "file_path", "bucket_name")})
    engine.index_segments("kb", segments)
    assert engine.vector_cells("kb") is None
    asked = spark.createDataFrame([(1, "bravo3 text 3"), (2, "alpha bravo11")], "query_id long, text string")
    query = SearchQuery(["kb"], top_k=4, num_candidates=None, filters={"type": "passage"})
    want = ranked(engine.search_field("kb", asked, query))
    engine.index_vectors("kb")
    found = engine.search_field("kb", asked, query)
    assert ranked(found) == want and "cells" in found.inputFiles()[0]
    engine.index_segments("kb", segments.limit(1))
    assert engine.vector_cells("kb") is None and ranked(engine.search_field("kb", asked, query)) == want


def test_a_reader_meets_no_half_pointer(spark, tmp_path):
    store = NodeStore(spark, f"file://{tmp_path}/s")
    row = spark.createDataFrame([("a", "passage", "x", None)], "hash_id string, type string, text string, entity_id string")
    store.upsert("kb", row)
    # a driver that died between create and write leaves an empty pointer, or one under its other name
    (tmp_path / "s/kb/CURRENT-000000002").touch()
    (tmp_path / "s/kb/_pointer-v2_dead").write_bytes(b"\0")
    assert store.exists("kb") and store.read(["kb"]).count() == 1 and store.names() == ["kb"]
    (tmp_path / "s/kb/CURRENT-000000002").unlink()
    store.upsert("kb", row.withColumn("hash_id", F.lit("b")))
    stale = store._current("kb")
    store.upsert("kb", row.withColumn("text", F.lit("y")))
    with pytest.raises(Exception, match="(?i)exist"):  # a writer that has not seen version 3
        store._replace("kb", stale, store.schema("kb"), map(int, stale["held"]), store.read(["kb"]))
    assert sorted((r.hash_id, r.text) for r in store.read(["kb"]).collect()) == [("a", "y"), ("b", "x")]
    assert not [f for f in (tmp_path / "s/kb").iterdir() if f.name.startswith("_pointer-v3")]


WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]


def texts(spark, seed, n, first=0):
    random = np.random.default_rng(seed)
    share = 1 / np.arange(1, 121)
    rows = [(f"d{first + i:05d}", " ".join(random.choice(WORDS, random.integers(1, 60), p=share / share.sum()))) for i in range(n)]
    return rows


QUESTIONS = [(1, "waa wab wac"), (2, "web web waa"), (3, "wdz waa wed wcc wab"), (4, "nothing here"), (5, None), (6, ""), (7, " ".join(WORDS[:40])), (8, "wzz waf")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, text string")


@pytest.mark.parametrize("per_range,depths", [(8, (1, 6)), (1024, (500,))])
def test_postings_find_what_a_whole_scan_finds(spark, asked, tmp_path, monkeypatch, per_range, depths):
    monkeypatch.setattr(postings, "PER_RANGE", per_range)
    rows = texts(spark, 1, 400) + [("x1", None), ("x2", ""), ("x3", "waa"), ("x4", "waa")]
    docs = spark.createDataFrame(rows, "hash_id string, text string").repartition(3)
    index = Postings.build(docs, f"file://{tmp_path}/p")
    for k in depths:
        assert ranked(index.search(asked, k)) == ranked(search.bm25_topk(docs, asked, k))
    some = docs.filter("hash_id > 'd00300'")
    assert ranked(index.search(asked, 6, some)) == ranked(search.bm25_topk(some, asked, 6, statistics=docs))


def test_postings_keep_up_with_writes(spark, asked, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "hash_id string, text string")
    a, b = texts(spark, 2, 120), texts(spark, 3, 60, 100)  # the last 20 of a come again in b, with other texts
    index = Postings.build(frame(a), f"file://{tmp_path}/p")
    index.replace(frame(a[100:]), frame(b))
    index.remove(frame(a[:15] + b[30:40]))
    index.add(frame(a[5:9]))  # removed, and there again
    now = frame(a[5:9] + a[15:100] + b[:30] + b[40:])
    assert ranked(index.search(asked, 300)) == ranked(search.bm25_topk(now, asked, 300))
    assert sum(r["n"] for r in index.sizes()) == now.count()


def test_a_search_reads_the_blocks_of_asked_terms_only(spark, asked, tmp_path):
    docs = spark.createDataFrame(texts(spark, 4, 300), "hash_id string, text string")
    index = Postings.build(docs, f"file://{tmp_path}/p")
    found = plan(index.search(asked.filter("query_id = 1"), 5))
    filters = re.findall(r"PartitionFilters: \[(.*)\]", found)
    assert any(re.search(r"bucket#\d+ IN \(\d+(,\d+){0,2}\)|bucket#\d+ = ", f) for f in filters)
    assert "CartesianProduct" not in found and "NestedLoop" not in found


def test_postings_of_nothing(spark, asked, tmp_path):
    assert Postings(spark, f"file://{tmp_path}/none").search(asked, 3).count() == 0
    empty = spark.createDataFrame([], "hash_id string, text string")
    assert Postings.build(empty, f"file://{tmp_path}/p").search(asked, 3).count() == 0


def test_engine_keeps_its_postings(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    rows = spark.createDataFrame([(f"Alphabet Bravissimo{i} text {i % 7}", f"f{i % 3}", i) for i in range(30)], "text string, file_id string, segment_id long")
    segments = rows.withColumns({c: F.lit(None).cast("string") for c in ("file_name", "file_path", "bucket_name")})
    engine.index_segments("kb", segments.filter("segment_id < 20"))
    engine.index_texts("kb")
    engine.index_segments("kb", segments.filter("segment_id > 15"))
    asked = spark.createDataFrame([(1, "bravissimo3 text 3"), (2, "alphabet bravissimo18 5")], "query_id long, text string")
    query = SearchQuery(["kb"], mode="bm25", top_k=5, filters={"type": "passage"})
    def same():
        now = engine.store.read(["kb"])
        return ranked(engine.search_field("kb", asked, query)) == ranked(search.bm25_topk(now.filter("type = 'passage'"), asked, 5, statistics=now))
    assert engine.postings("kb") is not None and same()
    engine.delete_files("kb", ["f1"])
    assert engine.postings("kb") is not None and same()
    engine.store.delete_files("kb", ["f2"])  # past the engine: the postings are of another version
    assert engine.postings("kb") is None and same()
