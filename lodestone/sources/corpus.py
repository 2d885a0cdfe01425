"""The star-schema and text tables of a folder as the engine's inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.ports import PatternExtractor
from lodestone.operators import ingest
from lodestone.tables import fresh_path

#: Paths of stored indexes by application, folder and name.
_STORED: dict[tuple[str, str, str], str] = {}


@dataclass(frozen=True)
class Corpus:
    """``documents`` as one file per source, ``embeddings`` as their vectors by id, ``benchmark`` as questions."""

    spark: SparkSession
    folder: str
    extractor: PatternExtractor = PatternExtractor()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str, build: Callable[[str], object]) -> str:
        """The path of an index over this folder's tables; ``build`` makes it in the session that asks first."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = fresh_path(self.spark, name)
            build(path)
            _STORED[key] = path
        return _STORED[key]

    @cached_property
    def segments(self) -> DataFrame:
        d = self.table("documents")
        none = F.lit(None).cast("string")
        return d.select(
            "doc_id", "lang", "text", F.col("source").alias("file_id"), F.concat("source", F.lit(".txt")).alias("file_name"), none.alias("file_path"), none.alias("bucket_name"), F.col("doc_id").alias("segment_id")
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))

    @cached_property
    def passages(self) -> DataFrame:
        return ingest.passages(self.segments).drop("bucket_name", "file_path")

    @cached_property
    def mentions(self) -> DataFrame:
        return ingest.mentions(self.passages, self.extractor)

    @cached_property
    def full(self) -> DataFrame:
        """Passages with entities and, where there is one, a vector."""
        rows = ingest.with_entities(self.passages, self.mentions)
        return rows.join(self.vectors, "doc_id", "left")

    @cached_property
    def texts(self) -> DataFrame:
        """Ids and texts alone; all that search by words reads."""
        return self.segments.select("doc_id", "lang", "text", ids.passage_id(ids.source_key(F.col("bucket_name"), F.col("file_path"), F.col("file_name"), F.col("file_id")), F.col("segment_id"), F.col("text")).alias("hash_id"))

    @cached_property
    def embedded(self) -> DataFrame:
        """The same with vectors; all that search without expansion reads."""
        return self.texts.join(self.vectors, "doc_id", "left")

    @cached_property
    def sentences(self) -> DataFrame:
        return ingest.sentences(self.passages, self.extractor)

    @cached_property
    def entities(self) -> DataFrame:
        return ingest.entity_nodes(self.mentions, self.passages, ingest.naming_lines(self.passages, self.extractor))

    @cached_property
    def logical(self) -> DataFrame:
        return ingest.logical_entities(self.entities)

    @cached_property
    def questions(self) -> DataFrame:
        b = self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
        return b.join(self.vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")

    @cached_property
    def snippets(self) -> DataFrame:
        """Conversation turns as loose snippets under their role."""
        c = self.table("conversations")
        return c.select("conv_id", "turn", F.col("role").alias("type"), "text", ids.snippet_id(F.col("role"), F.col("text")).alias("hash_id"))
