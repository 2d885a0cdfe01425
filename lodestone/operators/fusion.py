"""Expansion of a first recall over entities and neighbours, and weighted fusion of the lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ranking import exact_sum, ordered_distinct, reciprocal, top_k
from lodestone.operators.search import primary
from lodestone.schema import Config
from lodestone.tables import cut


def expansion_entities(hits: DataFrame, passages: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, entity_id, score, rank): the entities that the hits' importance by rank speaks for.

    An importance of 0 or null counts as 1; passages without ``entities`` give their ``entity_ids`` the weight 1.
    """
    own = passages.select("hash_id", "entities", "entity_ids")
    rows = hits.join(own, "hash_id")
    full = F.size(F.coalesce("entities", F.array().cast("array<struct<id:string,name:string,count:int,importance:double>>"))) > 0
    pairs = F.when(full, F.transform("entities", lambda e: F.struct(e["id"].alias("id"), F.coalesce(F.nullif(e["importance"], F.lit(0.0)), F.lit(1.0)).alias("w"))))
    pairs = pairs.otherwise(F.transform("entity_ids", lambda e: F.struct(e.alias("id"), F.lit(1.0).alias("w"))))
    each = rows.select("query_id", "rank", F.explode(pairs).alias("e")).select("query_id", F.col("e.id").alias("entity_id"), (F.col("e.w") / F.col("rank")).alias("w"))
    total = each.groupBy("query_id", "entity_id").agg(exact_sum(F.col("w")).alias("score"))
    return top_k(total, most, tie="entity_id").select("query_id", "entity_id", "score", "rank")


def entity_passages(chosen: DataFrame, passages: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, hash_id, rank): passages with any of a question's chosen entities, by id."""
    linked = passages.select("hash_id", F.explode("entity_ids").alias("entity_id")).distinct()
    met = linked.join(chosen.select("query_id", "entity_id"), "entity_id").select("query_id", "hash_id").distinct()
    order = Window.partitionBy("query_id").orderBy("hash_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: What sets the places of the entity list behind those of the first list.
BEHIND = 1_000_000_000


def neighbors(first: DataFrame, by_entity: DataFrame | None, passages: DataFrame) -> DataFrame:
    """(query_id, hash_id, ord): passages before and after the hits of both lists that are hits of neither, in the order of the first list, then of the second."""
    hits = first.select("query_id", "hash_id", F.col("rank").cast("long").alias("rank"))
    if by_entity is not None:
        hits = hits.unionByName(by_entity.select("query_id", "hash_id", (F.col("rank") + BEHIND).alias("rank")))
    near = passages.select("hash_id", "previous_passage_id", "next_passage_id")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("previous_passage_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("next_passage_id").alias("id")))
    each = hits.select("query_id", "hash_id", "rank").join(near, "hash_id").select("query_id", (2 * F.col("rank")).alias("r"), F.explode(sides).alias("s"))
    each = each.select("query_id", F.col("s.id").alias("hash_id"), (F.col("r") + F.col("s.side")).alias("o")).filter("hash_id IS NOT NULL")
    each = each.join(hits.select("query_id", "hash_id"), ["query_id", "hash_id"], "left_anti")
    return ordered_distinct(each, ["query_id", "hash_id"], F.col("o")).join(passages.select("hash_id"), "hash_id", "left_semi")


def fuse(first: DataFrame, by_entity: DataFrame | None, by_neighbor: DataFrame | None, k: int, config: Config = Config()) -> DataFrame:
    """Weighted reciprocal rank fusion: query_id, rank, hash_id, score, base_score, entity_expansion_score.

    The last two are the scores in the first two lists, null where a list lacks the passage.
    """
    w = config.weights
    empty = F.lit(None).cast("double")
    lists = first.select("query_id", "hash_id", reciprocal("rank", config.rrf_constant, w[0]).alias("s"), F.col("score").alias("base"), empty.alias("entity"))
    if by_entity is not None:
        lists = lists.unionByName(by_entity.select("query_id", "hash_id", reciprocal("rank", config.rrf_constant, w[1]).alias("s"), empty.alias("base"), F.lit(1.0).alias("entity")))
    if by_neighbor is not None:
        order = Window.partitionBy("query_id").orderBy("ord")
        ranked = by_neighbor.withColumn("rank", F.row_number().over(order))
        lists = lists.unionByName(ranked.select("query_id", "hash_id", reciprocal("rank", config.rrf_constant, w[2]).alias("s"), empty.alias("base"), empty.alias("entity")))
    fused = lists.groupBy("query_id", "hash_id").agg(exact_sum(F.col("s")).alias("score"), F.max("base").alias("base_score"), F.max("entity").alias("entity_expansion_score"))
    return top_k(fused, k).select("query_id", "rank", "hash_id", "score", "base_score", "entity_expansion_score")


def retrieve(passages: DataFrame, questions: DataFrame, mode: str, k: int = 5, config: Config = Config(), statistics: DataFrame | None = None) -> DataFrame:
    """A fast mode in full: first recall, entity and neighbour expansion, fusion.

    The lists, a few rows a question, are written as tables, since each stands in the plan several times.
    """
    first = cut(primary(passages, questions, mode, k, statistics), "first-recall")
    by_entity = by_neighbor = None
    if config.entity_expansion:
        chosen = expansion_entities(first, passages, config.entity_expansion_max)
        by_entity = cut(entity_passages(chosen, passages, config.entity_expansion_top_k), "entity-recall")
    if config.neighbor_expansion:
        by_neighbor = neighbors(first, by_entity, passages)
    return fuse(first, by_entity, by_neighbor, k, config)
