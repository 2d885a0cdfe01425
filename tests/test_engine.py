"""Small scenarios with hand-set values for ingest, search, graph ranking, chunking and stores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, text
from lodestone.functions.ports import HashingEmbedder, PatternExtractor
from lodestone.operators import chunking, fusion, graph, ingest, metrics, search, store
from lodestone.plans.engine import Engine, file_nodes
from lodestone.schema import Config, SearchQuery, has_field
from lodestone.sources.objects import ObjectStorage, checked_location
from lodestone.streaming.ingest import stream_into

SEGMENT = "text string, file_id string, file_name string, file_path string, bucket_name string, segment_id long"


class Fixed:
    def __init__(self, names):
        self.names = names

    def mentions(self, _):
        return F.array(*map(F.lit, self.names))


def test_ingest_metadata(spark):
    rows = spark.createDataFrame([("水库监测一", "file-1", "demo.pdf", None, None, 1), ("水库监测二", "file-1", "demo.pdf", None, None, 2)], SEGMENT)
    p = ingest.passages(rows)
    got = {r.segment_id: r for r in p.collect()}
    assert got[1].hash_id == "passage-bf11ffdda3e7d4b58cdc685dd1931473" and got[2].hash_id == "passage-45ec6cf6459d6b0b1fa03fc0ee5a8f8b"
    assert got[1].next_passage_id == got[2].hash_id and got[2].previous_passage_id == got[1].hash_id and got[1].previous_passage_id is None
    full = ingest.with_entities(p, ingest.mentions(p, Fixed(["水库", "水库", "监测", " "]))).first()
    by = {e.name: e for e in full.entities}
    assert by["水库"]["count"] == 2 and abs(by["水库"].importance - 0.792481250361) < 1e-9 and abs(by["监测"].importance - 0.5) < 1e-12
    assert by["水库"].id == "entity-1b2c05e5ad59d6dda928317fac64a490"
    nodes = file_nodes(rows, Fixed(["水库"]))
    assert {r.type for r in nodes.collect()} == {"passage", "sentence", "entity"}
    assert nodes.filter("type = 'entity'").first().hash_id == "entity-node-12a204b1d738a8f6705e69a1f27022e2"


def test_sources_are_kept_apart(spark):
    rows = spark.createDataFrame([("same", "a", None, None, None, 1), ("same", "b", None, None, None, 1), ("same", "a", None, "x", None, 1)], SEGMENT)
    p = ingest.passages(rows).collect()
    assert len({r.hash_id for r in p}) == 3 and all(r.next_passage_id is None and r.previous_passage_id is None for r in p)


def test_folded_and_snippet_ids(spark):
    r = spark.range(1).select(ids.entity_id(F.lit("Straße")).alias("a"), ids.snippet_id(F.lit("user"), F.lit("hello")).alias("b")).first()
    assert r.a == "entity-f68418110b56950369e54315d3634493" and r.b == "user-5d41402abc4b2a76b9719d911017c592"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.strip(F.lit("　 a b \n"))) == "a b"
    assert one(text.count_of(F.lit("aaaa"), F.lit("aa"))) == 2 and one(text.count_of(F.lit("ab"), F.lit(""))) == 3
    names = spark.createDataFrame([("劳动协议",), ("1000元元元",), ("ab",)], "n string")
    assert [r.n for r in names.filter(text.weak_entity(F.col("n"))).collect()] == ["劳动协议"]


def test_bm25_arithmetic(spark):
    p = spark.createDataFrame([("d1", "a b b"), ("d2", "a c"), ("d3", "c")], "hash_id string, text string")
    q = spark.createDataFrame([(1, "b a")], "query_id long, text string")
    got = {r.hash_id: r.score for r in search.bm25_scores(p, q).collect()}
    assert abs(got["d1"] - 0.714800546674) < 1e-9 and abs(got["d2"] - 0.213638013293) < 1e-9 and "d3" not in got


def test_fusion_arithmetic(spark):
    hit = spark.createDataFrame([(1, "a", 0.9, 1)], "query_id long, hash_id string, score double, rank int")
    by_entity = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, hash_id string, rank int")
    near = spark.createDataFrame([(1, "c", 5)], "query_id long, hash_id string, ord int")
    got = {r.hash_id: r for r in fusion.fuse(hit, by_entity, near, 5).collect()}
    want = {"a": 1 / 61 + 0.7 / 61, "b": 0.7 / 62, "c": 0.25 / 61}
    assert {x: r.score for x, r in got.items()} == pytest.approx(want, abs=1e-11)
    assert got["b"].base_score is None and got["c"].entity_expansion_score is None


def test_filters_match_arrays_and_nothing_matches_no_filter(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], "1"), ("b", None, "2")], "hash_id string, tags array<string>, kind string")
    assert [r.hash_id for r in search.filtered(rows, {"tags": ["y", "z"]}, 5).collect()] == ["a"]
    assert search.filtered(rows, {}, 5).count() == 0 and store.without_matching(rows, {"tags": "x"}).count() == 1
    with pytest.raises(ValueError):
        search.guarded(rows, {}, 1)
    assert search.bounded(rows, {}, 1).count() == 1


P = "hash_id string, text string, vector array<float>, entities array<struct<id:string,name:string,count:int,importance:double>>, entity_ids array<string>, next_passage_id string"


@pytest.fixture
def five_nodes(spark):
    p = spark.createDataFrame([("p1", "甲乙", [1.0, 0.0], [("a", "甲", 1, 1.0), ("b", "乙", 1, 1.0)], ["a", "b"], "p2"), ("p2", "乙", [0.9, 0.1], [("b", "乙", 1, 1.0)], ["b"], None)], P)
    s = spark.createDataFrame([("s1", "p1", ["a", "b"], [1.0, 0.0])], "hash_id string, passage_id string, entity_ids array<string>, vector array<float>")
    e = spark.createDataFrame([("a-node", "a", "甲", [1.0, 0.0]), ("b-node", "b", "乙", [0.9, 0.1])], "hash_id string, entity_id string, name string, vector array<float>")
    q = spark.createDataFrame([(1, "问题", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    n = spark.createDataFrame([(1, 0, "甲", [1.0, 0.0])], "query_id long, ord int, name string, vector array<float>")
    return p, s, e, q, n


def test_whole_graph_ranking(five_nodes):
    p, s, e, q, n = five_nodes
    got = graph.retrieve_full(p, s, e, q, n, 5).orderBy("rank").collect()
    assert [r.hash_id for r in got] == ["p1", "p2"] and [r.score for r in got] == pytest.approx([0.268526, 0.14639], abs=1e-6)


def test_local_graph_ranking_and_fallback(five_nodes):
    p, s, e, q, n = five_nodes
    few = Config(local_candidates=1, local_max_passages=10)
    assert [r.hash_id for r in graph.retrieve_local(p, s, e, q, n, 5, few).collect()] == ["p1"]
    linked = p.withColumn("entity_ids", F.when(F.col("hash_id") == "p2", F.array(F.lit("a"))).otherwise(F.col("entity_ids")))
    assert {r.hash_id for r in graph.retrieve_local(linked, s, e, q, n, 5, few).collect()} == {"p1", "p2"}
    assert graph.retrieve_local(p, s, e, q, n.limit(0), 1, few).first().hash_id == "p1"
    with pytest.raises(ValueError):
        graph.retrieve_full(p, s, e.limit(0), q, n, 5)
    with pytest.raises(ValueError):
        graph.retrieve_full(p, s, e, q, n, 5, Config(max_nodes=2))


def test_activation_order():
    w, reached = graph.activate({"a": 1.0}, {"a": [0], "b": [0]}, np.array([1.0]), [["a", "b"]], {"a", "b"})
    assert w == {"a": 2.0, "b": 1.0} and reached == {"a": (1.0, 2), "b": (1.0, 2)}


def test_distributed_pagerank_is_that_of_the_kernel(spark):
    src, dst = np.array([0, 1, 1, 2, 3]), np.array([1, 0, 2, 1, 3])
    w, r = np.array([1.0, 1.0, 0.5, 0.5, 0.0]), np.array([1.0, 0.0, 0.0, 2.0])
    want = graph.ranked_nodes(src, dst, w, r, 0.5)
    assert abs(want.sum() - 1) < 1e-9
    g = spark.createDataFrame(pd.DataFrame({"src": src.astype(str), "dst": dst.astype(str), "w": w}))
    reset = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(r)], "node string, r double")
    got = {int(x.node): x.score for x in graph.pagerank(g, reset).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(4))


def test_chunks(spark):
    pages = spark.createDataFrame([("f", 1, "前言内容\n1 总则\n本办法适用于公司。"), ("f", 2, "一、范围\n12345\n2 an overly long heading line")], "file string, page long, text string")
    got = [(r.title, r.page, r.text) for r in chunking.chunks_by_title(pages).orderBy("chunk").collect()]
    assert got == [("无标题内容", 1, "前言内容"), ("1 总则", 1, "# 1 总则\n本办法适用于公司。"), ("一、范围", 2, "# 一、范围\n12345\n2 an overly long heading line")]
    packed = chunking.merged_chunks(chunking.chunks_by_title(pages), above=2, target=25).orderBy("chunk").collect()
    assert [r.parts for r in packed] == [2, 1] and packed[0].title == "无标题内容"


def test_sections(spark):
    pages = spark.createDataFrame([("f", 1, "Alpha\nsome text that is long enough to stay here"), ("f", 2, "Betta\nmore text that is long enough to stay here as well")], "file string, page long, text string")
    toc = spark.createDataFrame([("f", 1, 1, "Alpha", 1, 2), ("f", 2, 2, "Beta", 2, 2)], "file string, ord int, level int, title string, page int, last_page int")
    got = chunking.sections(toc, pages).orderBy("ord").collect()
    assert got[0].text.startswith("Alpha\nsome") and got[1].text.startswith("Alpha\nBetta\nmore")


def test_metrics(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "query_id long, hash_id string")
    r = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (2, "c", 1), (2, "d", 2)], "query_id long, hash_id string, rank int")
    got = metrics.recall_at(r, t, (2,)).first()
    assert (got.any_at_k, got.passage_recall_at_k, got.all_at_k) == (1.0, 0.75, 0.5)


def test_objects(spark, tmp_path):
    for bucket, key in (("docs", "docs/../secret.pdf"), ("../docs", "a"), ("docs", "reports/a:b.pdf"), ("docs", ""), ("docs", "/a")):
        with pytest.raises(ValueError):
            checked_location(bucket, key)
    o = ObjectStorage(spark, f"file://{tmp_path}/o")
    o.put("docs", "reports/a.pdf", b"x")
    assert o.exists("docs", "reports/a.pdf") and o.get("docs", "reports/a.pdf") == b"x"
    with pytest.raises(FileExistsError):
        o.put("docs", "reports/a.pdf", b"y")
    assert o.delete("docs", "reports/a.pdf") and not (tmp_path / "o/docs").exists()


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", HashingEmbedder(16), PatternExtractor())
    e.create_kb("k")
    e.create_kb("k")
    rows = spark.createDataFrame([("Reservoir watches Waterline", "f1", "a", None, None, 1), ("Waterline only", "f1", "a", None, None, 2), ("nothing here", "f2", "b", None, None, 1)], SEGMENT)
    assert e.index_segments("k", rows) == {"new_passages": 3, "new_entities": 2, "failed_passages": 0, "skipped": False}
    before = e.store.read(["k"]).count()
    e.index_segments("k", rows)
    assert e.store.read(["k", "missing"]).count() == before and has_field(e.store.schema("k"), "entities.count")
    q = spark.createDataFrame([(1, "Where is the Reservoir")], "query_id long, text string")
    for mode in ("vector", "bm25", "hybrid", "linear", "linear_local"):
        first = e.retrieve(["k"], q, mode, 2).orderBy("rank").first()
        assert e.store.read(["k"]).filter(F.col("hash_id") == first.hash_id).first().text.startswith("Reservoir"), mode
    with pytest.raises(ValueError):
        e.retrieve(["k", "l"], q, "linear")
    assert e.search_field("k", q, SearchQuery(["k"], "bm25", 1)).count() == 1
    with pytest.raises(LookupError):
        e.search_field("none", q, SearchQuery(["none"]))
    snippet = e.index_snippets("k", spark.createDataFrame([("hello",)], "text string"), "user").first().hash_id
    assert e.delete_ids("k", [snippet, snippet]) == 1 and e.delete_files("k", ["f1"]) > 0
    assert {r.file_id for r in e.store.read(["k"]).collect()} == {"f2"}
    e.drop_kb("k")
    assert not e.store.exists("k")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("Reservoir one", "f1", "a", None, None, 1)], SEGMENT)
    rows.write.parquet(str(tmp_path / "in"))
    s = store.NodeStore(spark, f"file://{tmp_path}/kb")
    for _ in range(2):
        stream_into(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), s, "k", str(tmp_path / "cp"), PatternExtractor()).awaitTermination()
    assert s.read(["k"]).filter("type = 'passage'").count() == 1
