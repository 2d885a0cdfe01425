"""What decides which passages are found: lists, terms, counts, orders, budgets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import evaluation
from lodestone.functions import text, vectors
from lodestone.functions.ports import HashingEmbedder, PatternExtractor
from lodestone.operators import fusion, graph, ingest, metrics, nearest, search, store
from lodestone.plans.engine import Engine
from lodestone.schema import Config, SearchQuery
from lodestone.sources.pages import document_pages, structure

ENTITIES = "array<struct<id:string,name:string,count:int,importance:double>>"
NODE = f"hash_id string, text string, vector array<float>, entities {ENTITIES}, entity_ids array<string>, previous_passage_id string, next_passage_id string"


def test_neighbours_of_entity_hits_come_behind_those_of_the_first_list(spark):
    rows = spark.createDataFrame([(c, c, None, [], [], p, n) for c, p, n in (("a", None, "b"), ("b", "a", "c"), ("c", "b", "d"), ("d", "c", "e"), ("e", "d", None))], NODE)
    first = spark.createDataFrame([(1, "a", 1)], "query_id long, hash_id string, rank int")
    by_entity = spark.createDataFrame([(1, "d", 1), (1, "a", 2)], "query_id long, hash_id string, rank int")
    got = [r.hash_id for r in fusion.neighbors(first, by_entity, rows).orderBy("ord").collect()]
    assert got == ["b", "c", "e"]
    assert [r.hash_id for r in fusion.neighbors(first, None, rows).collect()] == ["b"]


@pytest.mark.parametrize(("question", "found"), [("水库监测", "p1"), ("2024", "p2"), ("café", "p3"), ("DON'T", "p4"), ("3.5", "p5"), ("Ёлка", "p6")])
def test_terms_of_any_script(spark, question, found):
    texts = ["水库监测方案", "the year 2024 ended", "un Café noir", "they don't know", "about 3.5 tons", "зелёная ёлка"]
    rows = spark.createDataFrame([(f"p{i + 1}", t) for i, t in enumerate(texts)], "hash_id string, text string")
    asked = spark.createDataFrame([(1, question)], "query_id long, text string")
    assert search.bm25_topk(rows, asked, 1).first().hash_id == found
    assert search.bm25_topk(rows, asked.withColumn("text", F.lit("nothing")), 1).isEmpty()


def test_terms(spark):
    got = spark.createDataFrame([("Ab-c d_1 1,000.5 中文x 'q' e’f",)], "t string").select(text.terms(F.col("t")).alias("t")).first().t
    assert got == ["ab", "c", "d_1", "1,000.5", "中", "文", "x", "q", "e’f"]


def test_statistics_of_the_whole_index_count(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", "x")], "hash_id string, text string")
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    more = rows.unionByName(spark.createDataFrame([(f"s{i}", "z z z") for i in range(8)], rows.schema))
    alone, whole = (search.bm25_topk(rows, asked, 1, statistics=s).first().score for s in (None, more))
    assert whole > alone  # x is rarer among ten rows than among two


def test_edges_count_names_in_the_text_as_it_is(spark):
    e = [("e1", "Dam", 9, 1.0), ("e2", "Gate", 1, 1.0)]
    rows = spark.createDataFrame([("p", "Dam dam Dam Gate", None, e, ["e1", "e2"], None, "q"), ("q", "neither", None, e, ["e1", "e2"], "p", "gone")], NODE)
    got = {(r.src, r.dst): r.w for r in graph.edges(rows).collect()}
    assert got == pytest.approx({("p", "e1"): 2 / 3, ("e1", "p"): 2 / 3, ("p", "e2"): 1 / 3, ("e2", "p"): 1 / 3, ("p", "q"): 1.0, ("q", "p"): 1.0})


def test_scores_that_differ_in_the_seventh_place_are_no_tie(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0 + 2e-7, 0.0]), ("z", None)], "hash_id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.hash_id for r in search.vector_topk(points, asked, 2, raw_dot=True).orderBy("rank").collect()] == ["b", "a"]


def test_copies_of_a_vector_tie_whatever_batch_they_stand_in(spark):
    chance = np.random.default_rng(1)
    one, asked = chance.normal(size=64).tolist(), 100 * chance.normal(size=(200, 64))
    points = spark.createDataFrame([(f"p{i:02d}", one) for i in range(31)], "hash_id string, vector array<double>").coalesce(1)
    questions = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id long, vector array<double>")
    rows, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, "5")  # six batches of five and one of one
    try:
        got = nearest.nearest(points, questions, 31, raw_dot=True).collect()
    finally:
        spark.conf.set(rows, before)
    assert len({(r.query_id, r.score) for r in got}) == 200
    assert all(r.hash_id == f"p{r.rank - 1:02d}" for r in got) and len(got) == 200 * 31


@pytest.mark.parametrize("raw", [True, False])
def test_nearest_in_blocks_is_that_of_a_join(spark, monkeypatch, raw):
    chance = np.random.default_rng(3)
    points = spark.createDataFrame([(f"p{i:03d}", chance.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)] + [("zero", [0.0] * 4)], "hash_id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(1, i, chance.integers(-2, 3, 4).astype(float).tolist()) for i in range(9)], "query_id long, ord int, vector array<double>").filter(F.exists("vector", lambda x: x != 0))
    run = lambda: sorted((r.ord, r.rank, r.hash_id, round(r.score, 9)) for r in nearest.nearest(points, asked, 7, ("query_id", "ord"), raw_dot=raw).collect())
    monkeypatch.setattr(nearest, "COLUMNS", 2)
    blocks = run()
    monkeypatch.setattr(nearest, "SENT_NUMBERS", 0)
    assert blocks == run() and len(blocks) == 7 * asked.count()
    assert nearest.nearest(points, asked.limit(0), 3, ("query_id", "ord")).isEmpty() and nearest.nearest(points.limit(0), asked, 3, ("query_id", "ord")).isEmpty()


def test_dense_scores_by_both_ways(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.0]), ("c", None)], "hash_id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    run = lambda: {(r.query_id, r.hash_id): r.dense for r in graph.dense_scores(rows, asked).collect()}
    want = {(1, "a"): 1.0, (1, "b"): 0.5, (1, "c"): 0.0, (2, "a"): 0.0, (2, "b"): 0.0, (2, "c"): 0.0}
    assert run() == want
    monkeypatch.setattr(nearest, "SENT_NUMBERS", 0)
    assert run() == want


def test_seeds_stand_in_the_order_of_their_names(spark):
    e = spark.createDataFrame([("n1", "e1", "E", [1.0, 0.0]), ("n2", "e2", "F", [0.0, 1.0]), ("n3", "e3", "G", None)], "hash_id string, entity_id string, name string, vector array<double>")
    asked = spark.createDataFrame([(1, 0, [0.0, 2.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "query_id long, ord int, vector array<double>")
    assert [(r.entity_id, r.score) for r in graph.seeds_full(asked, e).orderBy("ord").collect()] == [("e2", 1.0), ("e1", 1.0)]
    assert [r.entity_id for r in graph.seeds_local(asked, e, 1).collect()] == ["e2"]


def test_entities_without_a_vector_are_skipped(spark):
    nodes = spark.createDataFrame([("a", "e", "first", None), ("b", "e", "second", [1.0])], "hash_id string, entity_id string, name string, vector array<float>")
    assert [r.name for r in ingest.logical_entities(nodes).collect()] == ["second"]
    assert [r.name for r in ingest.logical_entities(nodes.drop("vector")).collect()] == ["first"]


def test_local_graph_finds_what_vectors_miss_and_keeps_to_its_budgets(spark):
    nodes, cases = evaluation.controlled(spark, 4)
    of = {t: nodes.filter(F.col("type") == t) for t in ("passage", "sentence", "entity")}
    questions, asked = cases.select("query_id", "text", "vector"), cases.select("query_id", F.lit(0).alias("ord"), F.col("entity").alias("name"), "vector")
    few = Config(local_candidates=2)
    run = lambda config: {r.query_id: r.hash_id for r in graph.retrieve_local(of["passage"], of["sentence"], of["entity"], questions, asked, 1, config).collect()}
    want = {r.query_id: r.target for r in cases.collect()}
    assert run(few) == want
    first = {r.query_id: r.hash_id for r in search.vector_topk(of["passage"], questions, 1).collect()}
    assert not set(first.items()) & set(want.items())
    with pytest.raises(Exception, match="nodes; a graph may have"):
        run(Config(local_candidates=2, max_nodes=3))
    unnamed = graph.retrieve_local(of["passage"], of["sentence"], of["entity"], questions, asked.limit(0), 1, few)
    assert {r.query_id: r.hash_id for r in unnamed.collect()} == first


def test_hub_graph(spark):
    nodes = evaluation.hub_graph(spark, 12, 2, 5)
    assert {r.type: r["count"] for r in nodes.groupBy("type").count().collect()} == {"passage": 12, "sentence": 24, "entity": 5}
    p = {r.hash_id: r for r in nodes.filter("type = 'passage'").collect()}
    assert p["passage-0"].previous_passage_id is None and p["passage-11"].next_passage_id is None and p["passage-4"].entity_ids == ["entity-4", "entity-0", "entity-1", "entity-2"]


def test_baseline_rank_moves_the_target_up(spark):
    nodes, cases = evaluation.controlled(spark, 3)
    p, e = nodes.filter("type = 'passage'"), nodes.filter("type = 'entity'")
    hits = search.vector_topk(p, cases, 9)
    asked = cases.select("query_id", F.lit(0).alias("ord"), "vector")
    got = evaluation.baseline_rank(hits, p, e, cases, asked)
    assert {r.query_id: r.hash_id for r in got.filter("rank = 1").collect()} == {r.query_id: r.target for r in cases.collect()}
    plain = evaluation.baseline_rank(hits, p, e, cases, asked.limit(0))
    assert sorted((r.query_id, r.rank, r.hash_id) for r in plain.collect()) == sorted((r.query_id, r.rank, r.hash_id) for r in hits.collect())


def test_modes_demo_and_timing(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", HashingEmbedder(32), PatternExtractor())
    assert evaluation.demo(e)["new_passages"] == 2
    timed = evaluation.Timed(e.store)
    assert timed.read(["demo"]).count() > 2 and len(timed.seconds["read"]) == 1 and timed.root == e.store.root
    q = spark.createDataFrame([(1, "Which Archive Directive names the Records Office")], "query_id long, text string")
    target = e.store.read(["demo"]).filter("segment_id = 2").select(F.lit(1).cast("long").alias("query_id"), "text")
    rows, seconds = evaluation.run_modes(e, "demo", q, target, k=2, cuts=(1, 2))
    got = {(r.mode, r.k): r.any_at_k for r in rows.collect()}
    assert set(seconds) == {"vector", "hybrid", "linear", "linear_local"} and all(got[m, 2] == 1.0 for m in seconds)


def test_files_are_parsed_and_scanned_ones_raise(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", HashingEmbedder(8))
    done = e.index_file("k", "docs", "reports/a.txt", "1 Scope\nReservoir text\f2 Terms\nmore".encode())
    assert done["new_passages"] == 2
    rows = e.store.read(["k"]).filter("type = 'passage'").orderBy("segment_id").collect()
    assert [(r.file_name, r.file_path, r.bucket_name, r.pages_number) for r in rows] == [("a.txt", "reports/a.txt", "docs", 1), ("a.txt", "reports/a.txt", "docs", 2)]
    with pytest.raises(Exception, match="scanned"):
        e.index_file("k", "docs", "b.txt", b" \n \f ")
    assert not e.objects.exists("docs", "b.txt") and e.store.read(["k"]).filter("type = 'passage'").count() == 2
    assert e.delete_nodes("k", e.store.read(["k"]).filter("segment_id = 2")) >= 1 and e.delete_nodes("none", e.store.read(["k"])) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("one\ftwo")
    pages = document_pages(spark, str(tmp_path / "in"))
    assert [r.text for r in pages.orderBy("page").collect()] == ["one", "two"]
    toc = spark.createDataFrame([("f", 1), ("f", 3)], "file string, level int")
    got = {r.file: (r.strategy, r.max_title_level) for r in structure(spark.createDataFrame([("f",), ("g",)], "file string"), toc).collect()}
    assert got == {"f": ("titlesplit", 3), "g": ("chunksplit", None)}


def test_vector_modes_need_vectors(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    e.index_segments("k", spark.createDataFrame([("Reservoir", 1)], "text string, segment_id long"))
    q = spark.createDataFrame([(1, "Reservoir", [1.0])], "query_id long, text string, vector array<float>")
    with pytest.raises(ValueError, match="vector"):
        e.search_field("k", q, SearchQuery(["k"], "vector"))
    assert e.search_field("k", q, SearchQuery(["k"], "bm25", 1)).count() == 1


def test_question_prompt_stands_before_what_is_embedded(spark, tmp_path):
    class Echo:
        dim = 1

        def encode(self, c):
            return F.array(F.length(c).cast("float"))

    e = Engine(spark, f"file://{tmp_path}/e", Echo(), config=Config(question_prompt="12345"))
    q = spark.createDataFrame([(1, "abc")], "query_id long, text string")
    assert e._questions(q, True, e.config.question_prompt).first().vector == [8.0] and e._questions(q, True).first().vector == [3.0]


def test_writers_of_one_bucket_conflict_and_writers_of_others_both_commit(spark, tmp_path):
    def put(s, now, *names):
        rows = spark.createDataFrame([("k", n, f"text {n}") for n in names], "kb string, hash_id string, text string")
        touched = [r[0] for r in rows.select(s._bucket(now)).distinct().collect()]
        s._upsert("k", now, rows, touched, None)
        return set(touched)

    s, late = (store.NodeStore(spark, f"file://{tmp_path}/kb", buckets=8) for _ in range(2))
    s.create("k")
    held, now = s.read(["k"]), s._current("k")
    mine = put(s, now, "a")
    assert held.count() == 0 and s.exists("k")  # the frame from the version before still runs
    other = next(n for n in "bcdefghij" if not mine & {r[0] for r in spark.createDataFrame([(n,)], "hash_id string").select(s._bucket(now)).collect()})
    put(late, now, other)  # from the same manifest, another bucket
    assert {r.hash_id for r in s.read(["k"]).collect()} == {"a", other}
    before = s.version("k")
    with pytest.raises(store.Conflict):
        put(late, now, "a", "zz")
    assert s.version("k") == before and s.read(["k"]).count() == 2


def test_a_write_replaces_its_buckets_only(spark, tmp_path):
    s = store.NodeStore(spark, f"file://{tmp_path}/kb", buckets=8)
    rows = spark.range(200).selectExpr("'k' AS kb", "cast(id AS string) AS hash_id", "IF(id % 3 = 0, 'passage', 'entity') AS type", "concat('t', id) AS text", "cast(id % 7 AS string) AS file_id", "cast(null AS string) AS entity_id")
    s.upsert("k", rows)
    first = s._current("k")["held"]
    reader = s.read(["k"])
    s.upsert("k", spark.createDataFrame([("17", "entity", "new", 5, None)], "hash_id string, type string, text string, extra int, entity_id string"))
    second = s._current("k")["held"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    got = {r.hash_id: (r.text, r.extra) for r in s.read(["k"]).collect()}
    assert len(got) == 200 and got["17"] == ("new", 5) and got["18"] == ("t18", None)
    assert reader.filter("hash_id = '17'").first().text == "t17"  # a reader of the version before
    passages = s.read(["k"]).filter("type = 'passage'")
    assert passages.count() == 67
    scan = passages._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in scan
    assert s.delete_ids("k", ["17", "none"]) == 1 and s.delete_ids("k", ["none"]) == 0
    third = s._current("k")["held"]
    assert sum(second[b] != third.get(b) for b in second) == 1
    assert s.delete_files("k", list(range(7))) == 199 and s.read(["k"]).count() == 0 and "extra" in s.read(["k"]).columns
    s.upsert("k", spark.createDataFrame([("x", 5, "passage", None)], "hash_id string, extra long, type string, entity_id string"))
    assert s.read(["k"]).dtypes[-1] == ("extra", "bigint") and s.read(["k"]).count() == 1
    kept = {b for b, _ in s._current("k")["held"].items()}
    assert len(kept) == 1 and len(s._numbers("k")) == 2
    assert not (tmp_path / "kb" / "k" / f"version={first['0']}" / "_bucket=0").exists()


def test_small_functions(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0]], "Scope 1. General 1.2 part 2. More", [("Dam", "ORG"), ("first", "ORDINAL"), ("two", "CARDINAL"), ("Gate", None)])], "v array<array<double>>, t string, m array<struct<name:string,label:string>>")
    got = row.select(vectors.flat(F.col("v"), 2).alias("v"), text.broken_title(F.col("t")).alias("t"), text.named(F.col("m")).alias("m")).first()
    assert got.v == [1.0, 2.0, 3.0] and got.t == "Scope\n1. General 1.2 part\n2. More\n" and got.m == ["Dam", "Gate"]
    nodes = spark.createDataFrame([("a", "t", "f1")], "hash_id string, text string, file_id string")
    assert ingest.as_source(nodes).first().metadata.file_id == "f1"


def test_cases_are_filled_up_with_adjacent_passages(spark):
    p = spark.createDataFrame([("a", "b", "s", 1, ["Longest", "Short"]), ("b", "c", "s", 2, ["Middle"]), ("c", "d", "s", 3, ["no"]), ("d", None, "s", 4, ["Gamma"])], "hash_id string, next_passage_id string, source_key string, segment_id long, entity_names array<string>")
    cases = spark.createDataFrame([("b", "d", "x", "l", "r")], "left_id string, right_id string, bridge string, left_only string, right_only string")
    got = [(r.left_id, r.right_id, r.bridge, r.left_only, r.right_only) for r in metrics.backfilled(cases, p, 5).collect()]
    assert got == [("b", "d", "x", "l", "r"), ("a", "b", None, "Longest", "Middle")]
    rows = spark.createDataFrame([("g1", 1, "q"), ("g1", 2, "r"), ("g2", 1, "q"), ("g2", 2, "s")], "g string, o int, q string")
    assert [(r.g, r.turn) for r in metrics.round_robin(rows, "g", ["o"], 2, "q").collect()] == [("g1", 1), ("g1", 2)]
