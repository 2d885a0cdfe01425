"""Retrieval metrics and generators of weakly labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.scan import running


def recall_at(rankings: DataFrame, targets: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(k, questions, any_at_k, passage_recall_at_k, all_at_k) over questions with targets (query_id, hash_id)."""
    ks = targets.sparkSession.createDataFrame([(k,) for k in cuts], "k int")
    want = targets.distinct()
    size = want.groupBy("query_id").agg(F.count("*").alias("want"))
    hits = want.join(rankings.select("query_id", "hash_id", "rank"), ["query_id", "hash_id"])
    met = hits.crossJoin(F.broadcast(ks)).filter(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count_distinct("hash_id").alias("got"))
    every = size.crossJoin(F.broadcast(ks)).join(met, ["query_id", "k"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    share = lambda c: F.round(F.avg(c), 6)
    return every.groupBy("k").agg(
        F.count("*").alias("questions"),
        share((F.col("got") > 0).cast("double")).alias("any_at_k"),
        share(F.col("got") / F.col("want")).alias("passage_recall_at_k"),
        share((F.col("got") == F.col("want")).cast("double")).alias("all_at_k"),
    )


def target_positions(rankings: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, hash_id, rank): where the targets stand; null if they were not found."""
    return targets.join(rankings.select("query_id", "hash_id", "rank"), ["query_id", "hash_id"], "left")


def document_frequency(mentions: DataFrame) -> DataFrame:
    """(name, df)."""
    return mentions.groupBy("name").agg(F.count_distinct("hash_id").alias("df"))


def single_cases(mentions: DataFrame, limit: int | None = None) -> DataFrame:
    """(hash_id, name): per passage the first name that no other passage has."""
    unique = mentions.groupBy("name").agg(F.count_distinct("hash_id").alias("df"), F.min("hash_id").alias("hash_id")).filter("df = 1")
    cases = unique.groupBy("hash_id").agg(F.min("name").alias("name"))
    return cases if limit is None else cases.orderBy("name").limit(limit)


def templated_cases(mentions: DataFrame, templates: list[str]) -> DataFrame:
    """(question, name, hash_id): every unique name in every question pattern (``{}`` stands for the name)."""
    unique = mentions.groupBy("name").agg(F.count_distinct("hash_id").alias("df"), F.min("hash_id").alias("hash_id")).filter("df = 1")
    return unique.withColumn("t", F.explode(F.array(*map(F.lit, templates)))).select(F.replace("t", F.lit("{}"), F.col("name")).alias("question"), "name", "hash_id")


def bridges(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(left_id, right_id, bridge): passages that share a name which at most ``most`` have; rare names first, so no list is squared."""
    rare = document_frequency(mentions).filter(F.col("df").between(2, most)).select("name")
    held = mentions.select("name", "hash_id").distinct().join(rare, "name")
    left, right = (held.select("name", F.col("hash_id").alias(x)) for x in ("left_id", "right_id"))
    return left.join(right, "name").filter("left_id < right_id").groupBy("left_id", "right_id").agg(F.min("name").alias("bridge"))


def multihop_cases(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(left_id, right_id, bridge, left_only, right_only): bridged pairs with the first name that only one side has, on both sides."""
    names = mentions.groupBy("hash_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    pairs = bridges(mentions, most)
    pairs = pairs.join(names.select(F.col("hash_id").alias("left_id"), F.col("names").alias("ln")), "left_id")
    pairs = pairs.join(names.select(F.col("hash_id").alias("right_id"), F.col("names").alias("rn")), "right_id")
    own = lambda a, b: F.get(F.array_except(a, b), F.lit(0))
    rows = pairs.select("left_id", "right_id", "bridge", own("ln", "rn").alias("left_only"), own("rn", "ln").alias("right_only"))
    return rows.filter("left_only IS NOT NULL AND right_only IS NOT NULL")


def round_robin(rows: DataFrame, group: str, order: list[str], limit: int | None = None, question: str | None = None) -> DataFrame:
    """``rows`` with ``turn``: the first of every group, then the second of every group, and so on; the first ``limit`` in that order.

    Of rows with one ``question`` only the first counts; the others use up their turns and are left out.
    """
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if question is not None:
        first = rows.groupBy(question).agg(F.min(F.struct("turn", group, *order)).alias("_first"))
        rows = rows.join(first, question).filter(F.struct("turn", group, *order) == F.col("_first")).drop("_first")
    return rows if limit is None else rows.orderBy("turn", group, *order).limit(limit)


def backfilled(cases: DataFrame, passages: DataFrame, limit: int, lengths: tuple[int, int] = (4, 12)) -> DataFrame:
    """(left_id, right_id, bridge, left_only, right_only): ``cases``, then pairs of a passage and its next one until there are ``limit``.

    Such a pair has no bridge, and on each side the longest name of 4 to 12 characters, ties by name; a side
    without one, a pair that is a case already, and names that a pair before has, give none.
    """
    own = F.filter("entity_names", lambda n: F.length(n).between(*lengths))
    longest = F.element_at(F.array_sort(F.transform(own, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), 1)["n"]
    named = passages.select("hash_id", "next_passage_id", "source_key", F.col("segment_id").cast("string").try_cast("bigint").alias("at"), F.when(F.size(own) > 0, longest).alias("name"))
    right = named.select(F.col("hash_id").alias("right_id"), F.col("name").alias("right_only"))
    pairs = named.filter("next_passage_id IS NOT NULL AND name IS NOT NULL").join(right, F.col("next_passage_id") == F.col("right_id")).filter("right_only IS NOT NULL")
    pairs = pairs.select(F.col("hash_id").alias("left_id"), "right_id", F.lit(None).cast("string").alias("bridge"), F.col("name").alias("left_only"), "right_only", "source_key", "at")
    known = cases.select(F.least("left_id", "right_id").alias("_x"), F.greatest("left_id", "right_id").alias("_y")).distinct()
    pairs = pairs.withColumns({"_x": F.least("left_id", "right_id"), "_y": F.greatest("left_id", "right_id")}).join(known, ["_x", "_y"], "left_anti")
    once = pairs.groupBy("left_only", "right_only").agg(F.min(F.struct("source_key", "at", "left_id", "right_id")).alias("f"))
    more = once.select("f.left_id", "f.right_id", F.lit(None).cast("string").alias("bridge"), "left_only", "right_only", F.lit(1).alias("_list"), F.struct("f.source_key", "f.at", "f.left_id").alias("_o"))
    first = cases.select("left_id", "right_id", "bridge", "left_only", "right_only", F.lit(0).alias("_list"), F.struct(F.col("bridge").alias("source_key"), F.lit(0).cast("long").alias("at"), "left_id").alias("_o"))
    return first.unionByName(more).orderBy("_list", "_o").limit(limit).drop("_list", "_o")


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median, and the element at ``n * p`` of the sorted values: exact, from running counts of distinct values.

    Equal values are counted before they are sorted and a group's values lie in many ranges, so no task sorts a group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    upto = running(counts, group, [value], {"upto": "c"}).withColumn("_g", F.struct(F.col(group).alias("x")))
    sizes = upto.groupBy("_g").agg(F.max("upto").alias("n"))
    upto = upto.join(sizes, "_g")
    at = lambda i: F.max(F.when((i >= F.col("upto") - F.col("c")) & (i < F.col("upto")), F.col(value)))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    out = upto.groupBy(group).agg(
        F.max("n").alias("n"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"),
        *[at(place(p)).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)],
    )
    return out.select(group, "n", *[F.round(c, 6).alias(c) for c in ("median", "p50", "p95", "p99")])
