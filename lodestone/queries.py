"""The library's registered queries: each operator over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import ids, text
from lodestone.functions.ports import HashingEmbedder
from lodestone.functions.vectors import dot
from lodestone.operators import activation, chunking, fusion, graph, ingest, metrics, search, store
from lodestone.operators.cells import VectorCells
from lodestone.operators.names import occurrences
from lodestone.operators.postings import Postings
from lodestone.operators.ranking import PLACES, ordered_distinct
from lodestone.sources.corpus import Corpus
from lodestone.sources.pages import html_pages
from lodestone.tables import cut

#: Rows that an approximate vector query looks at.
BREADTH = 1200

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
    return f


def _r(c: Column | str) -> Column:
    return F.round(c, PLACES)


def _n(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _joined(c: str) -> Column:
    return F.array_join(c, ",")


@_register
def passage_ids(c: Corpus) -> DataFrame:
    return c.passages.select("doc_id", "source_key", "hash_id")


@_register
def passage_neighbors(c: Corpus) -> DataFrame:
    return c.passages.select("hash_id", "previous_passage_id", "next_passage_id")


@_register
def entity_mentions(c: Corpus) -> DataFrame:
    return c.mentions.select("hash_id", "name", ids.entity_id(F.col("name")).alias("entity_id"), _n("count").alias("count"))


@_register
def entity_importance(c: Corpus) -> DataFrame:
    return c.mentions.select("hash_id", "name", _n("count").alias("count"), _n("total").alias("total"), _r("importance").alias("importance"))


@_register
def passage_metadata(c: Corpus) -> DataFrame:
    return ingest.with_entities(c.passages, c.mentions).select("hash_id", _joined("entity_ids").alias("entity_ids"), _joined("entity_names").alias("entity_names"))


@_register
def entity_nodes(c: Corpus) -> DataFrame:
    return c.entities.select("hash_id", "entity_id", "name", "source_key")


@_register
def sentence_nodes(c: Corpus) -> DataFrame:
    return c.sentences.select("hash_id", "passage_id", F.size("entity_ids").cast("long").alias("n_entities"), F.array_join(F.array_sort("entity_ids"), ",").alias("entity_ids"))


@_register
def entity_collapse(c: Corpus) -> DataFrame:
    return c.logical


@_register
def entity_df_unique(c: Corpus) -> DataFrame:
    return metrics.document_frequency(c.mentions).select("name", "df", (F.col("df") == 1).alias("is_unique"))


@_register
def write_statistics(c: Corpus) -> DataFrame:
    nodes = c.passages.select(F.lit("passage").alias("type"), F.lit(None).cast("string").alias("entity_id"))
    return store.statistics(nodes.unionByName(c.entities.select(F.lit("entity").alias("type"), "entity_id")))


@_register
def filter_terms_array(c: Corpus) -> DataFrame:
    rows = ingest.with_entities(c.passages, c.mentions)
    found = search.filtered(rows, {"lang": ["en", "de"], "file_id": ["src0", "src3", "src7"], "entity_names": ["Therhean", "Anthin", "Thereon", "Ination", "Ertion"]}, 50)
    return found.select("hash_id", "lang", "file_id", "score")


@_register
def entity_passages_topn(c: Corpus) -> DataFrame:
    rows = ingest.with_entities(c.passages, c.mentions)
    return search.first_passages(rows, c.logical, 5).select("entity_id", "hash_id", _n("rn").alias("rn"))


@_register
def graph_nodes_bounded(c: Corpus) -> DataFrame:
    return search.bounded(c.sentences, {"file_id": ["src1", "src2"]}, 750).select("hash_id", "passage_id")


@_register
def vector_topk(c: Corpus) -> DataFrame:
    return search.vector_topk(c.embedded, c.questions, 10).select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def vector_topk_filtered(c: Corpus) -> DataFrame:
    rows = c.embedded.filter(search.predicate({"lang": "en"}, dict(c.embedded.dtypes)))
    return search.vector_topk(rows, c.questions, 10).select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


def _cells(c: Corpus) -> VectorCells:
    """Cells of the folder's vectors; built by the query that asks first, as an index is, and then read."""
    return VectorCells(c.spark, c.stored("cells", lambda path: VectorCells.build(c.embedded.select("hash_id", "lang", "vector"), path)))


@_register
def vector_topk_cells(c: Corpus) -> DataFrame:
    found = _cells(c).search(c.questions, 10, num_candidates=None)
    return found.select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def vector_topk_cells_filtered(c: Corpus) -> DataFrame:
    found = _cells(c).search(c.questions, 10, num_candidates=None, where=F.col("lang") == "en")
    return found.select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def vector_topk_candidates(c: Corpus) -> DataFrame:
    found = _cells(c).search(c.questions, 10, num_candidates=BREADTH)
    return found.select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def dense_fallback(c: Corpus) -> DataFrame:
    return search.vector_topk(c.embedded, c.questions, 5, raw_dot=True).select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


def _postings(c: Corpus) -> Postings:
    """Postings of the folder's texts; built by the query that asks first, as an index is, and then read."""
    return Postings(c.spark, c.stored("postings", lambda path: Postings.build(c.texts.select("hash_id", "text"), path)))


@_register
def bm25_topk(c: Corpus) -> DataFrame:
    return search.bm25_topk(c.texts, c.questions, 10).select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def bm25_topk_stored(c: Corpus) -> DataFrame:
    return _postings(c).search(c.questions, 10).select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def bm25_multi_field(c: Corpus) -> DataFrame:
    pages = html_pages(c.table("pages")).join(c.table("pages").select(F.col("page_id").alias("file"), "url"), "file").select(F.col("file").cast("string").alias("hash_id"), "text", "url")
    asked = c.questions.select("query_id", F.concat_ws(" ", "text", F.lit("http org example page")).alias("text"))
    return search.bm25_topk(pages, asked, 10, ("text", "url")).select("query_id", "hash_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def hybrid_retrieve(c: Corpus) -> DataFrame:
    return search.hybrid(c.embedded, c.questions, 5).select("query_id", _n("rank").alias("rank"), "hash_id", _r("score").alias("score"))


@_register
def neighbor_expand(c: Corpus) -> DataFrame:
    rows = cut(ingest.with_entities(c.passages.select("hash_id", "previous_passage_id", "next_passage_id"), c.mentions), "passages")
    hits = cut(search.bm25_topk(c.texts, c.questions, 20), "hits")
    by_entity = cut(fusion.entity_passages(fusion.expansion_entities(hits, rows), rows), "entity-hits")
    return fusion.neighbors(hits, by_entity, rows).select("query_id", "hash_id", _n("ord").alias("ord"))


@_register
def select_expansion_entities(c: Corpus) -> DataFrame:
    rows = cut(ingest.with_entities(c.texts.select("hash_id"), c.mentions), "passages")
    return fusion.expansion_entities(search.bm25_topk(c.texts, c.questions, 20), rows).select("query_id", "entity_id", _r("score").alias("score"), _n("rank").alias("rank"))


@_register
def expand_entity_passages(c: Corpus) -> DataFrame:
    rows = cut(ingest.with_entities(c.texts.select("hash_id"), c.mentions), "passages")
    chosen = fusion.expansion_entities(search.bm25_topk(c.texts, c.questions, 20), rows)
    return fusion.entity_passages(chosen, rows).select("query_id", "hash_id", _n("rank").alias("rank"))


def _retrieved(c: Corpus, mode: str) -> DataFrame:
    found = fusion.retrieve(cut(c.full, "passages"), c.questions, mode, 5)
    return found.select("query_id", _n("rank").alias("rank"), "hash_id", _r("score").alias("score"), _r("base_score").alias("base_score"), "entity_expansion_score")


@_register
def retrieve_vector(c: Corpus) -> DataFrame:
    return _retrieved(c, "vector")


@_register
def retrieve_bm25(c: Corpus) -> DataFrame:
    return _retrieved(c, "bm25")


@_register
def retrieve_hybrid(c: Corpus) -> DataFrame:
    return _retrieved(c, "hybrid")


@_register
def dense_minmax(c: Corpus) -> DataFrame:
    return graph.dense_scores(c.embedded, c.questions.filter("vector IS NOT NULL")).select("query_id", "hash_id", _r("dense").alias("dense"))


@_register
def graph_edges(c: Corpus) -> DataFrame:
    return graph.edges(ingest.with_entities(c.passages, c.mentions)).select("src", "dst", _r("w").alias("w"))


@_register
def passage_bonus(c: Corpus) -> DataFrame:
    named = c.table("nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.array("n_name", F.lit("thin"), F.lit("ertion")).alias("names"))
    activated = named.select("query_id", F.posexplode("names").alias("at", "name")).select("query_id", "name", (1.0 / (F.col("at") + 1)).alias("score"), (F.col("at") + 1).alias("tier"))
    return graph.passage_bonus(c.passages, activated).select("query_id", "hash_id", _r("bonus").alias("bonus")).filter("bonus > 0")


def _bipartite(c: Corpus) -> DataFrame:
    """Customers' nations and segments, as a small weighted graph."""
    each = c.table("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), "c_mktsegment").groupBy("src", F.col("c_mktsegment").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return each.unionByName(each.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


@_register
def ppr_fixed_iters(c: Corpus) -> DataFrame:
    reset = c.spark.createDataFrame([("n0", 2.0), ("BUILDING", 1.0)], "node string, r double")
    return graph.pagerank_rounds(_bipartite(c), reset, 3).select("node", _r("score").alias("score"))


def _vector_entities(c: Corpus) -> DataFrame:
    """Entities with the vector whose id their own hash picks, of all that the table has."""
    most = c.vectors.agg((F.max("doc_id") + 1).alias("n"))
    at = F.conv(F.substring("entity_id", 8, 6), 16, 10).cast("long") % F.col("n")
    return c.logical.crossJoin(F.broadcast(most)).withColumn("doc_id", at).join(c.vectors, "doc_id").drop("doc_id", "n")  # most is one row


def _asked(c: Corpus) -> DataFrame:
    """Two asked vectors a question: its own and another one."""
    b = c.table("benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.array("item_id", F.col("item_id") + 100)).alias("ord", "doc_id"))
    return b.join(c.vectors, "doc_id").drop("doc_id")


@_register
def seed_match_full(c: Corpus) -> DataFrame:
    return graph.seeds_full(_asked(c), _vector_entities(c)).select("query_id", "entity_id", _r("score").alias("score"))


@_register
def seed_match_local(c: Corpus) -> DataFrame:
    return graph.seeds_local(_asked(c), _vector_entities(c)).select("query_id", "entity_id", _r("score").alias("score"))


@_register
def candidate_merge(c: Corpus) -> DataFrame:
    linked = search.bm25_topk(c.texts, c.questions, 8).withColumnRenamed("rank", "ord")
    nearest = search.vector_topk(c.embedded, c.questions, 8)
    return graph.candidates(linked, nearest, 12).select("query_id", "hash_id", _n("ord").alias("ord"))


def _sentence_inputs(c: Corpus, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, ...]:
    """Sentence and entity nodes with hashed-text vectors, and the benchmark's questions with their names; each a table, as an index has them."""
    e = HashingEmbedder()
    lines = cut(ingest.sentences(rows, c.extractor).withColumn("vector", e.encode(F.col("text"))), "sentence-nodes")
    entities = cut(ingest.logical_entities(ingest.entity_nodes(found, rows, lines)).withColumn("vector", e.encode(F.col("name"))), "entity-nodes")
    questions = cut(c.table("benchmark").select(F.col("item_id").alias("query_id"), "text").withColumn("vector", e.encode(F.col("text"))), "questions")
    names = questions.select("query_id", F.posexplode(c.extractor.mentions(F.col("text"))).alias("ord", "name")).withColumn("vector", e.encode(F.col("name")))
    return lines, entities, questions, cut(names, "names")


def _graph_inputs(c: Corpus) -> tuple[DataFrame, ...]:
    """The same behind the passage nodes with their vectors."""
    rows, found = cut(c.passages, "passages"), cut(c.mentions, "mentions")
    passages = cut(ingest.with_entities(rows, found).withColumn("vector", HashingEmbedder().encode(F.col("text"))), "passage-nodes")
    return passages, *_sentence_inputs(c, rows, found)


@_register
def retrieve_linear_local(c: Corpus) -> DataFrame:
    return graph.retrieve_local(*_graph_inputs(c), 5).select("query_id", _n("rank").alias("rank"), "hash_id", _r("score").alias("score"))


@_register
def retrieve_linear(c: Corpus) -> DataFrame:
    return graph.retrieve_linear(*_graph_inputs(c), 5).select("query_id", _n("rank").alias("rank"), "hash_id", _r("score").alias("score"))


@_register
def entity_activation(c: Corpus) -> DataFrame:
    rows = cut(c.passages.select("hash_id", "source_key", "file_id", "text"), "passages")  # no neighbours, and no vectors of passages
    lines, entities, questions, names = _sentence_inputs(c, rows, cut(c.mentions, "mentions"))
    weights, reached = activation.activated(cut(graph.seeds_full(names, entities), "seeds"), lines, questions, entities)
    return weights.join(reached, ["query_id", "entity_id"]).select("query_id", "entity_id", _r("weight").alias("weight"), _r("score").alias("score"), _n("tier").alias("tier"))


@_register
def name_occurrences(c: Corpus) -> DataFrame:
    return occurrences(c.passages, c.logical)


@_register
def multi_kb_scan(c: Corpus) -> DataFrame:
    p = c.passages.select(F.lit("docs").alias("kb"), F.lit("passage").alias("type"), "hash_id")
    s = c.snippets.select(F.lit("dialog").alias("kb"), "type", "hash_id")
    rows = store.of_kbs(p.unionByName(s), ["docs", "dialog", "missing"])
    return rows.groupBy("kb", "type").agg(F.count("*").alias("n"), F.min("hash_id").alias("first_id"))


@_register
def upsert_merge(c: Corpus) -> DataFrame:
    rows = c.snippets.select("hash_id", "conv_id", "turn")
    old = rows.filter("turn = 0").dropDuplicates(["hash_id", "conv_id"]).groupBy("hash_id").agg(F.min("conv_id").alias("conv_id")).withColumn("turn", F.lit(0).cast("long"))
    new = rows.filter("turn > 0").withColumn("at", F.struct("conv_id", "turn"))
    return store.merged(old, new, ["hash_id"], "at").select("hash_id", "conv_id", "turn")


@_register
def lookup_by_ids(c: Corpus) -> DataFrame:
    bad = c.table("labels").filter("toxic = 1").select("doc_id")
    return store.by_ids(c.passages, bad, "doc_id").select("doc_id", "hash_id")


@_register
def delete_by_ids(c: Corpus) -> DataFrame:
    bad = c.table("labels").filter("toxic = 1").select("doc_id")
    return store.without_ids(c.passages, bad, "doc_id").select("doc_id", "hash_id")


@_register
def delete_by_file(c: Corpus) -> DataFrame:
    return store.without_matching(c.passages, {"file_id": ["src0", "src4"]}).groupBy("file_id").agg(F.count("*").alias("n"))


@_register
def snippet_upsert_ids(c: Corpus) -> DataFrame:
    return c.snippets.select("conv_id", "turn", "hash_id")


@_register
def segment_projection(c: Corpus) -> DataFrame:
    given = c.segments.withColumn("ori_text", F.when(F.col("lang") == "en", F.col("text")))
    rows = ingest.projected(given)
    return rows.select("file_name", "segment_id", F.md5(F.col("ori_text").cast("binary")).alias("ori_md5"), F.length("text").cast("long").alias("n_chars"))


@_register
def object_key_validate(c: Corpus) -> DataFrame:
    keys = c.table("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("key"))
    return keys.select("page_id", "key", text.valid_object_key(F.col("key")).alias("valid"), text.valid_bucket(F.col("key")).alias("valid_bucket"))


def _page_lines(c: Corpus) -> DataFrame:
    """The lines of ``documents``, numbered ones first where their id says so."""
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1 "), F.left(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit(12)), F.lit("\n"))).otherwise("")
    return c.table("documents").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), F.concat(head, F.col("text")).alias("text"))


@_register
def title_lines(c: Corpus) -> DataFrame:
    lines = chunking.page_lines(_page_lines(c))
    return lines.filter(text.is_title(F.col("line"))).select("file", "page", _n("line_no").alias("line_no"), "line")


@_register
def chunk_by_title(c: Corpus) -> DataFrame:
    rows = chunking.chunks_by_title(_page_lines(c))
    return rows.select("file", "chunk", "title", "page", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_register
def merge_small_chunks(c: Corpus) -> DataFrame:
    rows = chunking.merged_chunks(chunking.chunks_by_title(_page_lines(c)), above=10)
    return rows.select("file", "chunk", "title", "page", _n("parts").alias("parts"), F.length("text").cast("long").alias("n_chars"))


@_register
def page_chunks(c: Corpus) -> DataFrame:
    rows = chunking.numbered(chunking.chunks_by_title(html_pages(c.table("pages"))))
    return rows.select("file", "segment_id", "title", F.length("text").cast("long").alias("n_chars"))


def _toc(c: Corpus) -> DataFrame:
    """Table of contents: nations as entries of their regions."""
    n = c.table("nation")
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = n.select(F.col("n_regionkey").alias("file"), F.row_number().over(order).alias("ord"), F.col("n_name").alias("title"), "n_nationkey")
    return rows.select("file", "ord", "title", (1 + F.col("n_nationkey") % 3).cast("int").alias("level"), (F.col("ord") * 2).alias("page"), F.lit(99).alias("last_page"))


@_register
def toc_page_span(c: Corpus) -> DataFrame:
    return chunking.page_spans(_toc(c)).select(*[_n(x).alias(x) for x in ("file", "ord", "page", "end_page")], "title")


@_register
def toc_parent_titles(c: Corpus) -> DataFrame:
    return chunking.parent_titles(_toc(c)).select(_n("file").alias("file"), _n("ord").alias("ord"), "title", F.array_join("parents", "/").alias("parents"))


@_register
def toc_sections(c: Corpus) -> DataFrame:
    # a site is a file and its pages are that file's; their headings are its table of contents, with one letter lost or not
    pages, plain = c.table("pages"), lambda x: F.regexp_replace(x, "[^ -~\\n]", "?")
    site = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    texts = html_pages(pages).drop("page").join(pages.select(F.col("page_id").alias("file"), site.alias("site")), "file")
    texts = texts.select(F.col("site").alias("file"), F.col("file").alias("page"), plain(F.col("text")).alias("text"))
    title = text.strip(plain(F.replace(F.regexp_extract("html", "<h1>([^<]*)", 1), F.lit("&amp;"), F.lit("&"))))
    toc = pages.select(site.alias("file"), F.col("page_id").alias("ord"), (1 + F.col("page_id") % 3).cast("int").alias("level"), title.alias("title"), F.col("page_id").alias("page"))
    toc = toc.filter("title <> ''").withColumn("title", F.when(F.col("ord") % 2 == 0, F.expr("substr(title, 2)")).otherwise(F.col("title"))).withColumn("last_page", F.lit(1 << 40))
    rows = chunking.sections(toc, texts)
    return rows.select("file", _n("ord").alias("ord"), "title", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_register
def fuzzy_title_match(c: Corpus) -> DataFrame:
    # the distinct words of part names, as the entries of one file's table of contents and as the lines of its page
    words = c.table("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    words = words.select(F.lit(1).alias("file"), F.lit(1).alias("page"), "word", F.row_number().over(Window.orderBy("word")).alias("n"))
    toc = words.select("file", F.col("n").alias("ord"), F.lit(1).alias("level"), F.col("word").alias("title"), "page", F.col("page").alias("last_page"))
    found = chunking.title_lines(toc, words.select("file", "page", F.col("n").alias("line_no"), F.col("word").alias("line")))
    return found.select(_n("ord").alias("ord"), "title", _n("line_no").alias("line_no"))


def _relevant(c: Corpus) -> DataFrame:
    """Passages that hold a benchmark item word for word."""
    asked = c.questions.select("query_id", F.col("text").alias("name"))
    return occurrences(c.texts.filter("text IS NOT NULL").select("hash_id", "text"), asked).join(asked, "name").select("query_id", "hash_id")


@_register
def recall_at_k(c: Corpus) -> DataFrame:
    found = search.bm25_topk(c.texts, c.questions, 10)
    return metrics.recall_at(found, _relevant(c), (1, 3, 5, 10)).select(_n("k").alias("k"), "questions", "any_at_k", "passage_recall_at_k", "all_at_k")


@_register
def target_positions(c: Corpus) -> DataFrame:
    found = search.bm25_topk(c.texts, c.questions, 10)
    return metrics.target_positions(found, _relevant(c)).select("query_id", "hash_id", _n("rank").alias("rank"))


@_register
def single_target_cases(c: Corpus) -> DataFrame:
    return metrics.single_cases(c.mentions)


@_register
def templated_cases(c: Corpus) -> DataFrame:
    return metrics.templated_cases(c.mentions, ["What is {}?", "Where does {} occur?"])


@_register
def multihop_pairs(c: Corpus) -> DataFrame:
    return metrics.multihop_cases(c.mentions)


@_register
def round_robin_sample(c: Corpus) -> DataFrame:
    rows = metrics.round_robin(metrics.bridges(c.mentions), "bridge", ["left_id", "right_id"])
    return rows.select("bridge", "left_id", "right_id", _n("turn").alias("turn"))


@_register
def weak_entity_labels(c: Corpus) -> DataFrame:
    accept = lambda n: F.length(n).between(6, 16) & ~n.rlike("[0-9]")  # noqa: E731  Latin text: no Han share
    rows = metrics.single_cases(ingest.weak_labels(c.mentions, c.passages, accept))
    return rows


@_register
def latency_percentiles(c: Corpus) -> DataFrame:
    return metrics.percentiles(c.table("events"), "event_type", "value")


@_register
def ordered_distinct_users(c: Corpus) -> DataFrame:
    rows = ordered_distinct(c.table("events"), ["user_id"], F.col("event_id"))
    return rows.select("user_id", _n("ord").alias("ord"))


@_register
def vector_self_dot(c: Corpus) -> DataFrame:
    return c.vectors.select("doc_id", _r(dot(F.col("vector"), F.col("vector"))).alias("dot"))
