"""The engine's surface: knowledge bases, ingest, search and retrieval, all batched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.ports import DocumentParser, EmbeddingProvider, EntityExtractor, PatternExtractor
from lodestone.functions.vectors import present
from lodestone.operators import chunking, fusion, graph, ingest, search
from lodestone.operators.cells import VectorCells
from lodestone.operators.postings import Postings
from lodestone.operators.store import NodeStore, by_ids
from lodestone.schema import NODE_SCHEMA, Config, SearchQuery, has_field
from lodestone.sources.objects import ObjectStorage, checked_location
from lodestone.sources.pages import document_pages
from lodestone.tables import cut, release

MAX_UPLOAD = 100 << 20
#: Columns that no filter asks for; vector cells do without them.
HEAVY = ("text", "ori_text", "content_table", "content_image", "entities")


def _shaped(rows: DataFrame) -> DataFrame:
    """The columns of the node table but ``kb``, in its types; what is missing is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA if f.name != "kb"])


def file_nodes(segments: DataFrame, extractor: EntityExtractor, embedder: EmbeddingProvider | None = None) -> DataFrame:
    """Passage, sentence and entity nodes of segments (text, lineage, segment_id, ...)."""
    rows = ingest.passages(ingest.projected(segments))
    found = ingest.mentions(rows, extractor)
    lines = ingest.sentences(rows, extractor)
    nodes = ingest.entity_nodes(found, rows, lines)
    full = ingest.with_entities(rows, found)
    parts = [full.withColumn("type", F.lit("passage")), lines.withColumn("type", F.lit("sentence")), nodes.withColumns({"type": F.lit("entity"), "text": F.col("name")})]
    out = None
    for p in parts:
        p = _shaped(p.withColumn("vector", embedder.encode(F.col("text"))) if embedder else p)
        out = p if out is None else out.unionByName(p)
    return out


class Engine:
    """Knowledge bases under ``root``; ports bring embeddings and entity recognition."""

    def __init__(self, spark: SparkSession, root: str, embedder: EmbeddingProvider | None = None, extractor: EntityExtractor | None = None, config: Config = Config()):
        self.root = root.rstrip("/")
        self.spark, self.store, self.objects = spark, NodeStore(spark, f"{root}/kb"), ObjectStorage(spark, f"{root}/objects")
        self.embedder, self.extractor, self.config = embedder, extractor or PatternExtractor(), config

    def create_kb(self, name: str) -> None:
        self.store.create(name)

    def drop_kb(self, name: str) -> None:
        self.store.drop(name)

    def index_segments(self, kb: str, segments: DataFrame) -> dict:
        return self._upsert(kb, file_nodes(segments, self.extractor, self.embedder))

    def _upsert(self, kb: str, rows: DataFrame) -> dict:
        """Writes nodes; postings that are up to date stay so, by a segment of their own."""
        postings = self.postings(kb)
        if postings is None:
            return self.store.upsert(kb, rows)
        rows = cut(rows, "nodes")
        old = by_ids(self.store.read([kb]).select("hash_id", "text"), rows)  # reads the version that stays until the next write
        counts = self.store.upsert(kb, rows)
        if not counts["skipped"]:
            postings.replace(old, rows.select("hash_id", "text").dropDuplicates(["hash_id"]), self.store.version(kb))
        release(rows)
        return counts

    def _deleted(self, kb: str, postings: Postings | None, gone: DataFrame | None, n: int) -> int:
        """The same after a delete of ``n`` rows, which ``gone`` reads from the version before."""
        if postings is not None and n:
            postings.remove(gone.select("hash_id", "text"), self.store.version(kb))
        return n

    def index_texts(self, kb: str) -> Postings:
        """Postings of the texts of a base; writes through the engine keep them up."""
        path = f"{self.root}/postings/{kb}"
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return Postings.build(self.store.read([kb]).select("hash_id", "text"), path, tag=self.store.version(kb))

    def postings(self, kb: str) -> Postings | None:
        """The stored postings, if they are those of the present version."""
        index = Postings(self.spark, f"{self.root}/postings/{kb}")
        return index if (tag := index.tag()) is not None and tag == self.store.version(kb) else None

    def index_pages(self, kb: str, pages: DataFrame, bucket: str | None = None, key: str | None = None) -> dict:
        """(file, page, text): chunked by titles, then indexed; ``bucket`` and ``key`` say where the file lies."""
        chunks = chunking.numbered(chunking.merged_chunks(chunking.chunks_by_title(pages)))
        name = F.lit(key.rsplit("/", 1)[-1]) if key else F.col("file").cast("string")
        place = [F.lit(bucket).cast("string").alias("bucket_name"), F.lit(key).cast("string").alias("file_path")]
        rows = chunks.select("text", F.col("file").cast("string").alias("file_id"), name.alias("file_name"), "segment_id", F.col("page").alias("pages_number"), *place)
        return self.index_segments(kb, rows)

    def index_file(self, kb: str, bucket: str, key: str, data: bytes, pages: DataFrame | None = None, parser: DocumentParser | None = None) -> dict:
        """Stores the object, parses it on the executors unless its pages are given, and writes its nodes.

        The nodes become visible in one step, last of all; if anything before fails, the object goes again.
        """
        if not kb.strip() or not data or len(data) > MAX_UPLOAD:
            raise ValueError("a knowledge base and a file of 1 byte to 100 MiB are needed")
        checked_location(bucket, key)
        self.objects.put(bucket, key, data)
        try:
            if pages is None:
                pages = document_pages(self.spark, self.objects.path(bucket, key), parser).withColumn("file", F.lit(key))
            return self.index_pages(kb, pages, bucket, key)
        except Exception:
            self.objects.delete(bucket, key)
            raise

    def index_snippets(self, kb: str, texts: DataFrame, keyword: str) -> DataFrame:
        """Writes loose snippets (text), returns their ids."""
        rows = texts.select("text", F.lit(keyword).alias("type"), ids.snippet_id(F.lit(keyword), F.col("text")).alias("hash_id")).dropDuplicates(["hash_id"])
        if self.embedder:
            rows = rows.withColumn("vector", self.embedder.encode(F.col("text")))
        self._upsert(kb, _shaped(rows))
        return rows.select("hash_id")

    def delete_nodes(self, kb: str, ids: DataFrame) -> int:
        """Takes back nodes by id (hash_id), as after a write that a caller gives up; none, or a missing base, is no error."""
        rows = self.store.read([kb])
        return self._deleted(kb, self.postings(kb), by_ids(rows, ids), self.store.delete_rows(kb, ids))

    def delete_ids(self, kb: str, gone: list[str]) -> int:
        rows = self.store.read([kb])
        return self._deleted(kb, self.postings(kb), rows.filter(F.col("hash_id").isin(list(gone))), self.store.delete_ids(kb, gone))

    def delete_files(self, kb: str, file_ids: list) -> int:
        rows = self.store.read([kb])
        return self._deleted(kb, self.postings(kb), rows.filter(F.col("file_id").isin([str(x) for x in file_ids])), self.store.delete_files(kb, file_ids))

    def index_vectors(self, kb: str, cells: int | None = None) -> VectorCells:
        """Coarse cells for the vectors of the present version of a base; a later write leaves it to exact scans until this runs again."""
        rows = self.store.read([kb])
        return VectorCells.build(rows.select(*[c for c in rows.columns if c not in HEAVY]), f"{self.root}/cells/{kb}/{self.store.version(kb)}", cells=cells)

    def vector_cells(self, kb: str) -> VectorCells | None:
        """The stored cells of the present version, if there are any."""
        path = f"{self.root}/cells/{kb}/{self.store.version(kb)}"
        ready = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/_SUCCESS")
        return VectorCells(self.spark, path) if ready.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(ready) else None

    def _questions(self, questions: DataFrame, needs_vector: bool, prompt: str = "") -> DataFrame:
        """``questions`` with vectors if they are needed; ``prompt`` stands before the text that is embedded."""
        if needs_vector and "vector" not in questions.columns:
            if not self.embedder:
                raise ValueError("this mode needs vectors or an embedder")
            return questions.withColumn("vector", self.embedder.encode(F.concat(F.lit(prompt), F.col("text"))))
        return questions

    def search_field(self, kb: str, questions: DataFrame, query: SearchQuery) -> DataFrame:
        """Search over all nodes of one knowledge base; the field and, for vector modes, vectors must exist."""
        if not self.store.exists(kb):
            raise LookupError(f"no knowledge base {kb}")
        rows = self.store.read([kb])
        for f in query.text_fields:
            if not has_field(rows.schema, f):
                raise ValueError(f"no field {f}")
        if query.mode != "bm25" and not query.filter_only and rows.filter(present(F.col("vector"))).isEmpty():
            raise ValueError(f"no node of {kb} has a vector")
        return self.search(rows, questions, query, self.vector_cells(kb) if query.mode == "vector" and not query.filter_only else None, self.postings(kb) if query.mode == "bm25" and query.text_fields == ("text",) else None)

    def search(self, rows: DataFrame, questions: DataFrame, query: SearchQuery, cells: VectorCells | None = None, postings: Postings | None = None) -> DataFrame:
        """One recall without expansion; ``cells`` of the same rows serve a vector search with the breadth that the query asks for, ``postings`` a text search."""
        if query.filter_only:
            return search.filtered(rows, query.filters, query.top_k)
        if query.mode not in ("vector", "bm25", "hybrid"):
            raise ValueError(f"{query.mode} is not a search mode")
        kept = rows.filter(search.predicate(query.filters, dict(rows.dtypes))) if query.filters else rows
        asked = self._questions(questions, query.mode != "bm25")
        if query.mode == "vector" and cells is not None:
            where = search.predicate(query.filters, dict(cells.rows.dtypes)) if query.filters else None
            found = cells.search(asked, query.top_k, query.num_candidates, where)
        elif query.mode == "vector":
            found = search.vector_topk(kept, asked, query.top_k)
        elif query.mode == "bm25" and postings is not None:
            found = postings.search(asked, query.top_k, kept.select("hash_id") if query.filters else None)
        elif query.mode == "bm25":
            found = search.bm25_topk(kept, asked, query.top_k, query.text_fields, rows)
        else:
            found = search.hybrid(kept, asked, query.top_k, self.config.rrf_constant, query.text_fields, rows)
        return found if query.source_fields is None else found.join(kept.select("hash_id", *query.source_fields), "hash_id")

    def retrieve(self, kbs: list[str], questions: DataFrame, mode: str = "vector", k: int = 3) -> DataFrame:
        """Retrieval with expansion (vector, bm25, hybrid) or by graph ranking (linear, linear_local)."""
        nodes = self.store.read(kbs)
        of = {t: nodes.filter(F.col("type") == t) for t in ("passage", "sentence", "entity")}
        if mode in ("vector", "bm25", "hybrid"):
            return fusion.retrieve(of["passage"], self._questions(questions, mode != "bm25", self.config.question_prompt), mode, k, self.config, nodes)
        if mode not in ("linear", "linear_local"):
            raise ValueError(f"unknown mode {mode}")
        if len(kbs) != 1:
            raise ValueError("graph ranking takes one knowledge base")
        asked = self._questions(questions, True)
        names = asked.select("query_id", F.posexplode(self.extractor.mentions(F.col("text"))).alias("ord", "name"))
        if not self.embedder:
            raise ValueError("graph ranking embeds the questions' entities")
        names = names.withColumn("vector", self.embedder.encode(F.col("name")))
        entities = of["entity"].withColumn("name", F.col("text"))
        run = graph.retrieve_linear if mode == "linear" else graph.retrieve_local
        return run(of["passage"], of["sentence"], entities, asked, names, k, self.config)
