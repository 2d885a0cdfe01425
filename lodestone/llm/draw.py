"""A bounded sample of rows for the driver, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_SPACE = 1 << 32


def least(rows: DataFrame, n: int, key: Column) -> list[Row]:
    """At most ``n`` of ``rows``: those with the least hash ``key``, ties by all columns.

    Rows are counted, and a bar on the hash lets about ``2 n`` of them into the sort, so every
    partition sends few. Only where so many rows are alike that none passes come any ``n`` of them.
    """
    total, at = rows.count(), F.pmod(key, F.lit(_SPACE))
    some = rows.withColumn("_at", at)
    if total > 4 * n:
        some = some.filter(F.col("_at") < int(_SPACE * (2 * n + 100) / total))
    return some.orderBy("_at", *rows.columns).limit(n).drop("_at").collect() or rows.limit(n).collect()
