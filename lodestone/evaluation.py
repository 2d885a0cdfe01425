"""Synthetic corpora, a baseline ranker and a runner over retrieval modes."""

from __future__ import annotations

import time
from collections import defaultdict
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators.graph import ranked_nodes
from lodestone.operators.nearest import nearest
from lodestone.plans.engine import Engine

_ENTITY = "array<struct<id:string,name:string,count:int,importance:double>>"


def _axis(at, size: int):
    """A unit vector along axis ``at``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == at).cast("float"))


def _entities(ids):
    return F.transform(ids, lambda e: F.struct(e.alias("id"), e.alias("name"), F.lit(1).alias("count"), F.lit(1.0).alias("importance"))).cast(_ENTITY)


def controlled(spark: SparkSession, groups: int = 8, near: tuple[float, ...] = (0.85, 0.75)) -> tuple[DataFrame, DataFrame]:
    """(nodes, cases): per group a question on an axis of its own, an entity and a sentence on that axis, a target passage that is
    orthogonal to every question, and passages near the question's axis that do not answer it.

    Vector search misses the targets; the path over the entity finds them. Cases are (query_id, text, entity, target, vector).
    """
    size, g = groups + 1, spark.range(groups).withColumn("g", F.col("id").cast("int")).drop("id")
    name, target = F.concat(F.lit("entity-"), "g"), F.concat(F.lit("target-"), "g")
    none = F.lit(None).cast("string")
    answer = F.concat(name, F.lit(": the answer in full"))

    def rows(kind, ident, text, vector, linked, entity=none, passage=none):
        ids = F.array(name) if linked else F.array().cast("array<string>")
        return g.select(F.lit(kind).alias("type"), ident.alias("hash_id"), text.alias("text"), vector.cast("array<float>").alias("vector"), ids.alias("entity_ids"), _entities(ids).alias("entities"), entity.alias("entity_id"), passage.alias("passage_id"), F.lit("eval").alias("file_id"))

    nodes = rows("entity", F.concat(F.lit("node-"), "g"), name, _axis(F.col("g"), size), False, entity=name)
    nodes = nodes.unionByName(rows("passage", target, answer, _axis(F.lit(groups), size), True))
    nodes = nodes.unionByName(rows("sentence", F.concat(F.lit("sentence-"), "g"), answer, _axis(F.col("g"), size), True, passage=target))
    for i, likeness in enumerate(near):
        bent = F.transform(F.sequence(F.lit(0), F.lit(groups)), lambda a, s=likeness: F.when(a == F.col("g"), 1.0).when(a == groups, 1.0 - s).otherwise(0.0))
        nodes = nodes.unionByName(rows("passage", F.concat(F.lit("distractor-"), "g", F.lit(f"-{i}")), F.concat(F.lit("alike but no answer "), "g", F.lit(f"-{i}")), bent, False))
    nodes = nodes.withColumns({"previous_passage_id": none, "next_passage_id": none, "name": F.col("text")})
    cases = g.select(F.col("g").cast("long").alias("query_id"), F.concat(F.lit("question-"), "g").alias("text"), name.alias("entity"), target.alias("target"), _axis(F.col("g"), size).alias("vector"))
    return nodes, cases


def hub_graph(spark: SparkSession, passages: int, sentences: int = 3, entities: int = 100) -> DataFrame:
    """Nodes of a chain of passages whose entities, four each in rotation, are shared by all: hubs for skew and ranking."""
    none, links = F.lit(None).cast("string"), min(4, entities)
    p = spark.range(passages).withColumnRenamed("id", "i")
    vector = F.array(F.lit(1.0), F.col("i") / 1e6, *[F.lit(0.0)] * 6).cast("array<float>")
    ids = F.transform(F.sequence(F.lit(0), F.lit(links - 1)), lambda o: F.concat(F.lit("entity-"), F.pmod(F.col("i") + o, F.lit(entities)).cast("string")))
    own = F.concat(F.lit("passage-"), F.col("i").cast("string"))
    follow = lambda at, ok: F.when(ok, F.concat(F.lit("passage-"), at.cast("string")))
    rows = p.select(F.lit("passage").alias("type"), own.alias("hash_id"), F.concat(F.lit("benchmark passage "), F.col("i").cast("string")).alias("text"), vector.alias("vector"), ids.alias("entity_ids"), _entities(ids).alias("entities"), none.alias("entity_id"), none.alias("passage_id"), follow(F.col("i") - 1, F.col("i") > 0).alias("previous_passage_id"), follow(F.col("i") + 1, F.col("i") + 1 < passages).alias("next_passage_id"))
    lines = p.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sentences - 1)))) if sentences else p.limit(0).withColumn("s", F.lit(0))
    place = F.concat(F.col("i").cast("string"), F.lit("-"), F.col("s").cast("string"))
    empty = F.array().cast("array<string>")
    rows = rows.unionByName(lines.select(F.lit("sentence").alias("type"), F.concat(F.lit("sentence-"), place).alias("hash_id"), F.concat(F.lit("benchmark sentence "), place).alias("text"), vector.alias("vector"), ids.alias("entity_ids"), _entities(empty).alias("entities"), none.alias("entity_id"), own.alias("passage_id"), none.alias("previous_passage_id"), none.alias("next_passage_id")))
    e = spark.range(entities).select(F.concat(F.lit("entity-"), F.col("id").cast("string")).alias("e"))
    rows = rows.unionByName(e.select(F.lit("entity").alias("type"), F.col("e").alias("hash_id"), F.col("e").alias("text"), F.array(F.lit(1.0), *[F.lit(0.0)] * 7).cast("array<float>").alias("vector"), empty.alias("entity_ids"), _entities(empty).alias("entities"), F.col("e").alias("entity_id"), none.alias("passage_id"), none.alias("previous_passage_id"), none.alias("next_passage_id")))
    return rows.withColumns({"file_id": F.lit("benchmark"), "name": F.col("text")})


class Timed:
    """Wraps an object; ``seconds`` holds the wall time of each call by method name."""

    def __init__(self, inner):
        self._inner, self.seconds = inner, defaultdict(list)

    def __getattr__(self, name: str):
        found = getattr(self._inner, name)
        if not callable(found):
            return found

        def call(*args, **kwargs):
            began = time.perf_counter()
            try:
                return found(*args, **kwargs)
            finally:
                self.seconds[name].append(time.perf_counter() - began)

        return call


def run_modes(engine: Engine, kb: str, questions: DataFrame, targets: DataFrame, modes: tuple[str, ...] = ("vector", "hybrid", "linear", "linear_local"), k: int = 15, cuts: tuple[int, ...] = (1, 3, 5, 8, 10, 15), runs: int = 1) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """(recall by mode and cut, seconds by mode): all questions at once in each mode, after one run that warms up.

    Targets are texts (query_id, text), as ids differ between indexes. Seconds are the median and the 95th percentile of ``runs``.
    """
    texts = engine.store.read([kb]).filter("type = 'passage'").select("hash_id", "text")
    wanted = targets.join(texts, "text").select("query_id", "hash_id")
    out, seconds = None, {}
    for mode in modes:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            found = engine.spark.createDataFrame(engine.retrieve([kb], questions, mode, k).select("query_id", "hash_id", "rank").collect(), "query_id long, hash_id string, rank int")
            took.append(time.perf_counter() - began)
        seconds[mode] = {"median": median(took[1:]), "p95": sorted(took[1:])[min(runs - 1, int(runs * 0.95))]}
        rows = metrics.recall_at(found, wanted, cuts).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out, seconds


def baseline_rank(hits: DataFrame, passages: DataFrame, entities: DataFrame, questions: DataFrame, asked: DataFrame, most_nodes: int = 100_000) -> DataFrame:
    """(query_id, rank, hash_id, score): the ranker that graph ranking is held against.

    ``hits`` (query_id, hash_id, score) are re-ranked. From the entity nearest to each asked name (query_id, ord, vector) two hops go over
    passages, five an entity that no hop had before; an entity's score is passed on times the passage's nearness to the question, at
    0.5 or more. A hit's base is 0.6 of its scaled score and the log of what activated entities' names in its text give; half of it
    and half of a PageRank (damping 0.85) that restarts at all with a score over 0.5 make the result. Hits of a question without seeds keep their order.
    """
    if passages.count() + entities.count() > most_nodes:
        raise ValueError(f"the baseline ranks at most {most_nodes} nodes")
    seeds = nearest(entities, asked, 1, ("query_id", "ord"), ("entity_id", "hash_id"), raw_dot=True)
    seeds = seeds.groupBy("query_id", "entity_id").agg(F.max_by("score", "ord").alias("score"))
    p = passages.select("hash_id", "text", "vector", "entity_ids", "entities", "next_passage_id").toPandas().sort_values("hash_id").to_dict("records")  # at most most_nodes rows
    names = {r["entity_id"]: r["name"] for r in entities.filter("vector IS NOT NULL").select("entity_id", "name", "hash_id").orderBy(F.col("hash_id").desc()).collect()}
    at = {r["hash_id"]: r for r in p}
    of: dict[str, list[str]] = defaultdict(list)
    for r in p:
        for e in r["entity_ids"]:
            of[e].append(r["hash_id"])

    def spread(start: dict[str, float], qv: np.ndarray) -> dict[str, float]:
        reached, edge, seen = dict(start), dict(start), set()
        for _ in range(2):
            further: dict[str, float] = {}
            for e, s in edge.items():
                near = [x for x in of.get(e, ()) if x not in seen][:5] if s >= 0.01 else []
                seen.update(near)
                for x in near:
                    passed = s * float(np.asarray(at[x]["vector"], float) @ qv)
                    if passed >= 0.5:
                        for other in at[x]["entity_ids"]:
                            further[other] = max(further.get(other, 0.0), passed)
            reached, edge = reached | further, further
        return reached

    def rank(t: pd.DataFrame) -> pd.DataFrame:
        found = t[t.kind == "hit"].sort_values(["score", "hash_id"], ascending=[False, True])
        order, result = list(found.hash_id), {x: float(s) for x, s in zip(found.hash_id, found.score, strict=True)}
        start = {r.key: float(r.score) for r in t[t.kind == "seed"].itertuples()}
        if start and order:
            reached = spread(start, np.asarray(t[t.kind == "q"].vector.iloc[0], float))
            lo, hi = min(result.values()), max(result.values())
            base, number, edges = {}, {x: i for i, x in enumerate(order)}, {}
            for x in order:
                own, text = at[x], at[x]["text"].lower()
                bonus = sum(s * np.log1p(text.count(names[e].lower())) for e, s in reached.items() if e in names and e in own["entity_ids"])
                base[x] = 0.6 * ((result[x] - lo) / (hi - lo) if hi > lo else 0.5) + np.log1p(bonus)
                counts = {e["id"]: own["text"].count(e["name"]) for e in own["entities"] if e["id"] in names}
                total = sum(counts.values())
                links = [(e, c / total) for e, c in counts.items()] if total else []
                if own["next_passage_id"] in base or own["next_passage_id"] in result:
                    links.append((own["next_passage_id"], 1.0))
                for y, w in links:
                    a, b = number[x], number.setdefault(y, len(number))
                    edges[a, b] = edges[b, a] = w
            restart = {n for n, s in {**reached, **base}.items() if s > 0.5}
            reset = np.array([float(n in restart) for n in number]) if restart else np.ones(len(number))
            pairs = np.array(list(edges), int).reshape(-1, 2)
            score = ranked_nodes(pairs[:, 0], pairs[:, 1], np.array(list(edges.values()), float), reset, 0.85)
            result = {x: 0.5 * base[x] + 0.5 * float(score[number[x]]) for x in order}
            order = sorted(order, key=lambda x: (-result[x], x))
        return pd.DataFrame({"query_id": [t.query_id.iloc[0]] * len(order), "rank": np.arange(1, len(order) + 1, dtype=np.int32), "hash_id": order, "score": [result[x] for x in order]})

    none = F.lit(None)
    parts = hits.select("query_id", F.lit("hit").alias("kind"), "hash_id", none.cast("string").alias("key"), F.col("score").cast("double").alias("score"), none.cast("array<float>").alias("vector"))
    parts = parts.unionByName(seeds.select("query_id", F.lit("seed").alias("kind"), none.cast("string").alias("hash_id"), F.col("entity_id").alias("key"), "score", none.cast("array<float>").alias("vector")))
    parts = parts.unionByName(questions.select("query_id", F.lit("q").alias("kind"), none.cast("string").alias("hash_id"), none.cast("string").alias("key"), none.cast("double").alias("score"), F.col("vector").cast("array<float>").alias("vector")))
    return parts.groupBy("query_id").applyInPandas(rank, "query_id long, rank int, hash_id string, score double")


def demo(engine: Engine, kb: str = "demo") -> dict:
    """Indexes two short passages, as a first run of a new installation."""
    rows = [("Retention runs for ten years under the Archive Directive.", 1), ("The Archive Directive names Records Office as its keeper.", 2)]
    segments = engine.spark.createDataFrame(rows, "text string, segment_id long").withColumns({"file_id": F.lit("demo"), "file_name": F.lit("demo.txt")})
    engine.create_kb(kb)
    return engine.index_segments(kb, segments)
