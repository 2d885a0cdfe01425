"""Places and running sums over a whole table's order, without a task that holds the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.tables import cut


def running(rows: DataFrame, keys: list, sums: dict[str, str] | None = None, label: str = "ordered") -> DataFrame:
    """``rows`` as they stand in the order of ``keys``: with ``k``, their place from 0, and for each (name: column) of
    ``sums`` under that name the column's sum over the row and all before it.

    Rows are dealt to ranges of the order; a range's rows are numbered within it, and what all ranges before add
    comes from a table of one row a range. ``keys`` (names) must order the rows totally.
    """
    sums = sums or {}
    dealt = cut(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    each = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    each = each.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(*keys)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("k", (F.row_number().over(own) - 1).cast("long")).withColumns({f"_own_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    out = out.join(F.broadcast(each), "_range")  # one row a range
    return out.select(*rows.columns, (F.col("k") + F.col("_n")).alias("k"), *[(F.col(f"_own_{n}") + F.col(f"_sum_{n}")).alias(n) for n in sums])
