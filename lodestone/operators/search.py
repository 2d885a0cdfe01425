"""Retrieval over a table of passages for a table of questions.

Questions are (query_id, text, vector); passages are (hash_id, text, vector, ...). All
results are (query_id, hash_id, score, rank).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.nearest import nearest
from lodestone.operators.ranking import reciprocal, top_k
from lodestone.operators.scoring import SENT_TERMS, asked_terms, blocks, counted, scored
from lodestone.tables import cut


def predicate(filters: dict, types: dict[str, str]) -> Column:
    """All of ``filters``: a scalar means equality, a list any of it; on array columns containment and overlap."""
    out = F.lit(True)
    for name, want in filters.items():
        many = not isinstance(want, str) and hasattr(want, "__iter__")
        if types[name].startswith("array"):
            one = F.arrays_overlap(F.col(name), F.array(*map(F.lit, want))) if many else F.array_contains(name, want)
        else:
            one = F.col(name).isin(list(want)) if many else F.col(name) == want
        out = out & F.coalesce(one, F.lit(False))
    return out


def filtered(nodes: DataFrame, filters: dict, k: int) -> DataFrame:
    """Structured recall: all rows that match score 1; no filter finds nothing."""
    if not filters or k <= 0:
        return nodes.limit(0).withColumn("score", F.lit(1.0))
    return nodes.filter(predicate(filters, dict(nodes.dtypes))).withColumn("score", F.lit(1.0)).orderBy("hash_id").limit(k)


def vector_topk(passages: DataFrame, questions: DataFrame, k: int, raw_dot: bool = False) -> DataFrame:
    """Exact nearest passages; the score is (1 + cosine) / 2, or the inner product."""
    return nearest(passages, questions, k, raw_dot=raw_dot)


def _bm25(passages: DataFrame, questions: DataFrame, k: int | None, field: str, statistics: DataFrame | None) -> DataFrame:
    asked = cut(asked_terms(questions), "asked-terms")
    wanted = asked.select("term").distinct()
    terms = [r["term"] for r in wanted.limit(SENT_TERMS + 1).collect()]

    def lists(rows: DataFrame) -> DataFrame:
        """The counted terms of a table, those that are asked for if they are few enough to send."""
        held = cut(counted(rows, field, terms if len(terms) <= SENT_TERMS else None), "postings")
        if held.groupBy("hash_id").count().filter("count > 1").isEmpty():
            return held
        each = held.select("hash_id", "dl", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("t")).groupBy("hash_id", "dl", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").cast("int").alias("tf"))
        one = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))  # the terms of one id
        return cut(each.groupBy("hash_id", "dl").agg(one.alias("t")).select("hash_id", "dl", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")), "postings")

    rows = lists(passages)
    base = rows if statistics is None else lists(statistics)
    n, mean = base.agg(F.count("*"), F.avg("dl")).first()
    df = cut(base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi"), "frequencies")
    return reduce(DataFrame.unionByName, [scored(rows, block, questions, k) for block in blocks(asked, df, n, mean)])


def bm25_scores(passages: DataFrame, questions: DataFrame, field: str = "text", statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, hash_id, score) by BM25 over ``field``; ``statistics`` (default: the passages) gives N, df and the mean length.

    Each question counts a term once for each time that it has it. Texts are cut into terms once: lengths and the
    counts of the terms that are asked for become a table, a row a passage.
    """
    return _bm25(passages, questions, None, field, statistics)


def bm25_topk(passages: DataFrame, questions: DataFrame, k: int, fields: tuple[str, ...] = ("text",), statistics: DataFrame | None = None) -> DataFrame:
    """The best field counts."""
    # a passage among the best has its greatest score in a field in which it is among the best
    rows = reduce(DataFrame.unionByName, [_bm25(passages, questions, k, f, statistics) for f in fields])
    if len(fields) > 1:
        rows = rows.groupBy("query_id", "hash_id").agg(F.max("score").alias("score"))
    return top_k(rows, k).select("query_id", "hash_id", "score", "rank")


def hybrid(passages: DataFrame, questions: DataFrame, k: int, constant: int = 60, fields: tuple[str, ...] = ("text",), statistics: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of the vector and the text ranking, each four times as deep as ``k``, 20 at least."""
    deep = max(4 * k, 20)
    both = vector_topk(passages, questions, deep).unionByName(bm25_topk(passages, questions, deep, fields, statistics))
    fused = both.groupBy("query_id", "hash_id").agg(F.sum(reciprocal("rank", constant)).alias("score"))
    return top_k(fused, k).select("query_id", "hash_id", "score", "rank")


def primary(passages: DataFrame, questions: DataFrame, mode: str, k: int, statistics: DataFrame | None = None) -> DataFrame:
    """First recall of a fast mode, four times as deep as what is asked for; ``statistics`` are those of the whole index."""
    deep = max(4 * k, 20)
    if mode == "vector":
        return vector_topk(passages, questions, deep)
    if mode == "bm25":
        return bm25_topk(passages, questions, deep, statistics=statistics)
    if mode == "hybrid":
        return hybrid(passages, questions, deep, statistics=statistics)
    raise ValueError(f"not a fast mode: {mode}")


def first_passages(passages: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """(entity_id, hash_id, rn): per seed entity its first ``n`` passages by id."""
    from pyspark.sql.window import Window

    linked = passages.select("hash_id", F.explode(F.array_distinct("entity_ids")).alias("entity_id")).join(seeds.select("entity_id").distinct(), "entity_id", "left_semi")
    order = Window.partitionBy("entity_id").orderBy("hash_id")
    return linked.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).select("entity_id", "hash_id", "rn")


def bounded(nodes: DataFrame, filters: dict, n: int) -> DataFrame:
    """A filtered read of the first ``n`` ids; more rows are no error."""
    return nodes.filter(predicate(filters, dict(nodes.dtypes))).orderBy("hash_id").limit(max(0, n))


def guarded(nodes: DataFrame, filters: dict, most: int) -> DataFrame:
    """A filtered scan that raises rather than cut when more than ``most`` rows match."""
    found = nodes.filter(predicate(filters, dict(nodes.dtypes)))
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows match")
    return found
