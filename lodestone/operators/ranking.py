"""Ranks with a total order: scores that agree in ``TIES`` places tie, and ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places to which registered queries round what they show, and places that two scores must agree in to be a tie.
#: Sums of doubles differ in the last places with their order; twelve keep those from deciding.
PLACES, TIES = 6, 12


def top_k(rows: DataFrame, k: int, by: str | list[str] = "query_id", score: str = "score", tie: str = "hash_id") -> DataFrame:
    """The first ``k`` of each ``by``, with ``rank`` from 1; Spark cuts each partition to ``k`` before it shuffles."""
    rows = rows.withColumn(score, F.round(score, TIES))
    order = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_sum(x: Column) -> Column:
    """The sum of doubles below 2^40, to 2^-56 each, that no order of summation changes: the whole and the fractional parts are summed as integers."""
    high = F.floor(x * F.lit(float(1 << 16)))
    low = F.floor((x * F.lit(float(1 << 16)) - high.cast("double")) * F.lit(float(1 << 40)))
    return F.sum(high) / F.lit(float(1 << 16)) + F.sum(low) / F.lit(float(1 << 56))


def ordered_distinct(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Each key once, with ``ord``: its first place."""
    return rows.groupBy(*keys).agg(F.min(order).alias("ord"))


def reciprocal(rank: Column | str, constant: int = 60, weight: float = 1.0) -> Column:
    """A list's share in reciprocal rank fusion."""
    return F.lit(float(weight)) / (F.lit(float(constant)) + (F.col(rank) if isinstance(rank, str) else rank))
