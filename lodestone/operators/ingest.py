"""From files' segments to passage, sentence and entity nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import ids
from lodestone.functions.ports import EntityExtractor
from lodestone.functions.text import count_of, strip
from lodestone.functions.vectors import present
from lodestone.tables import cut


LINEAGE = ("file_id", "file_name", "file_path", "bucket_name")


def projected(segments: DataFrame) -> DataFrame:
    """Segments with all lineage columns (null where missing) and ``ori_text``, which is the text unless another one is given."""
    for c in LINEAGE:
        if c not in segments.columns:
            segments = segments.withColumn(c, F.lit(None).cast("string"))
    own = F.coalesce(F.nullif(F.col("ori_text"), F.lit("")), F.col("text")) if "ori_text" in segments.columns else F.col("text")
    return segments.withColumn("ori_text", own)


def passages(segments: DataFrame) -> DataFrame:
    """Segments (text, file_id, file_name, file_path, bucket_name, segment_id) as passages with ids and neighbours.

    Neighbours are within a source; a segment number that is no integer sorts as 0, by its text.
    """
    key = ids.source_key(*map(F.col, ("bucket_name", "file_path", "file_name", "file_id")))
    rows = segments.withColumn("source_key", key)
    rows = rows.withColumn("hash_id", ids.passage_id(F.col("source_key"), F.col("segment_id"), F.col("text")))
    number = F.try_cast(F.col("segment_id").cast("string"), "bigint") if hasattr(F, "try_cast") else F.col("segment_id").cast("string").try_cast("bigint")
    tie = F.when(number.isNull(), F.concat_ws(":", F.col("segment_id").cast("string"), "hash_id")).otherwise(F.col("hash_id"))
    order = Window.partitionBy("source_key").orderBy(F.coalesce(number, F.lit(0)), tie)
    return rows.withColumns({"previous_passage_id": F.lag("hash_id").over(order), "next_passage_id": F.lead("hash_id").over(order)})


def mentions(rows: DataFrame, extractor: EntityExtractor) -> DataFrame:
    """(hash_id, name, count, total, importance): distinct stripped names of each passage.

    Importance is log(1 + count) by log(1 + all mentions of the passage).
    """
    each = rows.select("hash_id", F.explode(extractor.mentions(F.col("text"))).alias("name")).withColumn("name", strip(F.col("name"))).filter("name <> ''")
    counts = each.groupBy("hash_id", "name").agg(F.count("*").alias("count"))
    counts = counts.withColumn("total", F.sum("count").over(Window.partitionBy("hash_id")))
    return counts.withColumn("importance", F.log1p(F.col("count").cast("double")) / F.log1p(F.col("total").cast("double")))


def with_entities(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Passages with ``entities``, ``entity_ids`` and ``entity_names``, in the names' order; empty arrays without mentions."""
    entity = F.struct(F.col("name"), ids.entity_id(F.col("name")).alias("id"), F.col("count").cast("int").alias("count"), "importance")
    per = found.groupBy("hash_id").agg(F.array_sort(F.collect_list(entity)).alias("e"))
    rows = rows.join(per, "hash_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<name:string,id:string,count:int,importance:double>>")))
    named = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["count"].alias("count"), x["importance"].alias("importance")))
    return rows.withColumns({"entities": named, "entity_ids": F.col("e.id"), "entity_names": F.col("e.name")}).drop("e")


def _lines(rows: DataFrame) -> DataFrame:
    lines = rows.select("source_key", F.col("hash_id").alias("passage_id"), "file_id", F.explode(F.split("text", "\n")).alias("text"))
    return lines.withColumn("text", strip(F.col("text"))).filter("text <> ''")


def _naming(lines: DataFrame, extractor: EntityExtractor) -> DataFrame:
    return lines.withColumn("names", F.array_distinct(extractor.mentions(F.col("text")))).filter(F.size("names") > 0)


def naming_lines(rows: DataFrame, extractor: EntityExtractor) -> DataFrame:
    """(source_key, file_id, names) of the lines that mention anything; lines that repeat stay, so no text is shuffled."""
    return _naming(_lines(rows), extractor).select("source_key", "file_id", "names")


def sentences(rows: DataFrame, extractor: EntityExtractor) -> DataFrame:
    """Sentence nodes: the distinct non-blank lines of each passage that mention anything."""
    lines = _naming(_lines(rows).distinct(), extractor)
    return lines.withColumns({"hash_id": ids.sentence_id(F.col("passage_id"), F.col("text")), "entity_ids": F.transform("names", ids.entity_id)})


def entity_nodes(found: DataFrame, rows: DataFrame, lines: DataFrame) -> DataFrame:
    """A node for each source and name, of passages and sentences together; sources without sentences have none."""
    of_passages = found.select("hash_id", "name").join(rows.select("hash_id", "source_key", "file_id"), "hash_id").select("source_key", "file_id", "name")
    of_lines = cut(lines.select("source_key", "file_id", F.explode("names").alias("name")).distinct(), "names-of-lines")  # read twice, found once
    names = of_passages.unionByName(of_lines).distinct().join(of_lines.select("source_key").distinct(), "source_key", "left_semi")
    return names.withColumns({"hash_id": ids.entity_node_id(F.col("source_key"), F.col("name")), "entity_id": ids.entity_id(F.col("name"))})


def logical_entities(nodes: DataFrame) -> DataFrame:
    """One node an entity: the least node id; where nodes have a ``vector`` column, of those with a vector, which comes along."""
    if "vector" in nodes.columns:
        some = nodes.filter(present(F.col("vector")))
        return some.groupBy("entity_id").agg(F.min(F.struct("hash_id", "name", "vector")).alias("x")).select("entity_id", "x.hash_id", "x.name", "x.vector")
    return nodes.groupBy("entity_id").agg(F.min(F.struct("hash_id", "name")).alias("x")).select("entity_id", "x.hash_id", "x.name")


def as_source(nodes: DataFrame) -> DataFrame:
    """Nodes as a search answers them: every column, and all but id, text and vector once more in ``metadata``."""
    return nodes.withColumn("metadata", F.struct(*[F.col(f"`{c}`") for c in nodes.columns if c not in ("hash_id", "text", "vector")]))


def weak_labels(found: DataFrame, rows: DataFrame, accept) -> DataFrame:
    """(hash_id, name, count, importance = log(1 + count)): mentions that may serve as labels, counted in the text as it is."""
    named = found.filter(accept(F.col("name"))).join(rows.select("hash_id", "text"), "hash_id")
    counted = named.withColumn("count", count_of(F.col("text"), F.col("name"))).filter("count > 0")
    return counted.select("hash_id", "name", "count", F.log1p(F.col("count").cast("double")).alias("importance"))
