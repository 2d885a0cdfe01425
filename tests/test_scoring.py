"""BM25 in batches: what is shuffled, ties, blocks of questions."""

from lodestone import queries
from lodestone.operators import fusion, scoring, search
from lodestone.operators.postings import Postings
from lodestone.sources.corpus import Corpus


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _docs(spark, n=120):
    words = [f"w{i}x" for i in range(40)]
    rows = [(f"d{i:03d}", " ".join(words[(i * 7 + j * j) % 40] for j in range(5 + i % 30))) for i in range(n)]
    return spark.createDataFrame(rows, "hash_id string, text string").repartition(4)


def _asked(spark):
    return spark.createDataFrame([(i, " ".join(f"w{(i * 3 + j) % 40}x" for j in range(12))) for i in range(5)], "query_id long, text string")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.hash_id, r.score) for r in df.collect())


def test_scores_are_not_shuffled_by_pairs(spark, tmp_path):
    docs, asked = _docs(spark), _asked(spark)
    pairs = "hashpartitioning(query_id"
    for found in (search.bm25_topk(docs, asked, 3), Postings.build(docs, f"file://{tmp_path}/p").search(asked, 3)):
        lines = [x for x in _plan(found).split("\n") if pairs in x]
        assert lines and not any("hash_id" in x for x in lines)  # a question's best alone


def test_copies_tie_whatever_the_order_of_their_words(spark, tmp_path):
    asked = spark.createDataFrame([(1, " ".join(f"t{chr(97 + i)} " * (1 + i % 3) for i in range(26)))], "query_id long, text string")
    words = [f"t{chr(97 + i)}" for i in range(26) for _ in range(1 + i * i % 4)]
    rows = [(f"c{i:03d}", " ".join(words[i % 50 :] + words[: i % 50])) for i in range(150)] + [(f"o{i}", f"t{chr(97 + i % 26)} other") for i in range(60)]
    docs = spark.createDataFrame(rows, "hash_id string, text string").repartition(7)
    scores = {r.score for r in search.bm25_scores(docs, asked).filter("hash_id LIKE 'c%'").collect()}
    assert len(scores) == 1
    for found in (search.bm25_topk(docs, asked, 20), Postings.build(docs, f"file://{tmp_path}/p").search(asked, 20)):
        assert [r.hash_id for r in found.orderBy("rank").collect()] == [f"c{i:03d}" for i in range(20)]


def test_blocks_of_questions_and_small_steps_change_nothing(spark, monkeypatch):
    docs, asked = _docs(spark), _asked(spark)
    want = _rows(search.bm25_topk(docs, asked, 4))
    monkeypatch.setattr(scoring, "SENT_TERMS", 13)
    monkeypatch.setattr(search, "SENT_TERMS", 13)
    monkeypatch.setattr(scoring, "CELLS", 10)
    assert _rows(search.bm25_topk(docs, asked, 4)) == want


def test_sums_of_entities_do_not_hang_on_order(spark):
    entity = "array<struct<id:string,name:string,count:int,importance:double>>"
    shares = [0.1, 0.7, 0.3, 0.9, 1e-9, 0.123456789, 0.2, 0.6]
    rows = spark.createDataFrame([(f"p{i}", [("e", "E", 1, s)], ["e"]) for i, s in enumerate(shares)], f"hash_id string, entities {entity}, entity_ids array<string>")
    hits = [spark.createDataFrame([(q, f"p{i}", 1) for i in order], "query_id long, hash_id string, rank int").repartition(q, "hash_id") for q, order in ((1, range(8)), (2, range(7, -1, -1)), (3, (3, 1, 4, 0, 5, 2, 6, 7)))]
    scores = {r.score for h in hits for r in fusion.expansion_entities(h, rows).collect()}
    assert len(scores) == 1 and abs(scores.pop() - sum(shares)) < 1e-12


def test_targets_are_found_without_a_join_of_all_pairs(spark, tmp_path):
    spark.createDataFrame([(1, "s", "en", "one two"), (2, "s", "en", None), (3, "s", "en", "two three")], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "two"), (8, "two"), (9, "four"), (10, ""), (11, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries._relevant(Corpus(spark, str(tmp_path)))
    assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)
    assert sorted(r.query_id for r in found.collect()) == [7, 7, 8, 8, 10, 10]
