"""Numbers, running sums and open levels along an order, without a task that holds a group.

Rows are dealt to ranges of (group, order), so a group of any size lies in many ranges and many groups in one. What the
ranges before add to a group is carried over from a table of one row for each range and group that meet: that many rows
and no more, whatever the rows behind them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.tables import cut


def dealt(rows: DataFrame, group: str, order: list[str], label: str = "ranges") -> DataFrame:
    """``rows`` as a table with ``_range``, the number of their range of (group, order), and ``_g``, the group in a struct, as it may be null."""
    return cut(rows.repartitionByRange(F.col(group), *order).withColumns({"_range": F.spark_partition_id(), "_g": F.struct(F.col(group).alias("x"))}), label)


def running(rows: DataFrame, group: str, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``place`` (long, from 0) within their group, and for each (name: column) of ``sums`` the column's sum over the row and all before it.

    ``order`` must order the rows of a group totally; a sum of nulls alone is 0. Rows of a null group are a group.
    """
    sums, held = sums or {}, dealt(rows, group, order)
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    each = held.groupBy("_range", "_g").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    add = {"_b_place": "_n", **{f"_b_{n}": f"_t_{n}" for n in sums}}
    each = each.select("_range", "_g", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for b, c in add.items()])
    own = Window.partitionBy("_range", "_g").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({"_o_place": F.row_number().over(own).cast("long") - 1, **{f"_o_{n}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}})
    out = out.join(each, ["_range", "_g"])
    return out.select(*rows.columns, *[(F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(n) for n in ("place", *sums)])


def following(rows: DataFrame, group: str, order: list[str], column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``column`` of the next row of the group; null at its end."""
    held = dealt(rows, group, order)
    first = held.groupBy("_range", "_g").agg(F.min_by(F.struct(column), F.struct(*order)).alias("_first"))
    first = first.select("_range", "_g", F.lead("_first").over(Window.partitionBy("_g").orderBy("_range")).alias("_after"))  # one row a range
    own = F.lead(F.struct(column)).over(Window.partitionBy("_range", "_g").orderBy(*order))
    out = held.withColumn("_own", own).join(first, ["_range", "_g"])
    return out.select(*rows.columns, F.coalesce("_own", "_after")[column].alias(name))


def _push(stack: list, level: int, title: str | None) -> list:
    """The open levels after an entry: those above it, and itself."""
    return [s for s in stack if s[0] < level] + [(level, title)]


_STACK = "array<struct<level:long,title:string>>"


def open_levels(entries: DataFrame, group: str, order: str) -> DataFrame:
    """Entries (group, order, level, title) with ``parents``: titles of the open entries of lower level, outermost first.

    The open levels after a range follow from those before it and from its own: of those before, the ones below every
    level that the range holds. So each range is read once by itself, the stacks are joined range after range, and each
    is read again from its stack; batches stream through, and what is kept is one stack. Without a level an entry
    has no parents and closes nothing.
    """
    held = dealt(entries, group, [order])
    slim = held.select("_range", F.to_json("_g").alias("_k"), order, F.col("level").cast("long").alias("level"), "title")
    lined = slim.repartition("_range").sortWithinPartitions("_range", "_k", order)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack, low, out = None, [], None, []
        for batch in batches:
            for r, k, level, title in zip(batch["_range"], batch["_k"], batch["level"], batch["title"]):
                if (r, k) != at:
                    if at is not None:
                        out.append((*at, low, [{"level": a, "title": t} for a, t in stack]))
                    at, stack, low = (r, k), [], None
                if not pd.isna(level):
                    stack, low = _push(stack, int(level), title), int(level) if low is None else min(low, int(level))
            yield pd.DataFrame(out, columns=["_range", "_k", "low", "stack"]).astype({"low": "Int64"})
            out = []
        if at is not None:
            yield pd.DataFrame([(*at, low, [{"level": a, "title": t} for a, t in stack])], columns=["_range", "_k", "low", "stack"]).astype({"low": "Int64"})

    each = cut(lined.mapInPandas(ends, f"_range int, _k string, low long, stack {_STACK}"), "stacks")
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range and group
    past = F.collect_list(F.struct("low", "stack")).over(before)
    joined = F.aggregate(past, F.array().cast(_STACK), lambda acc, x: F.concat(F.filter(acc, lambda s: x["low"].isNull() | (s["level"] < x["low"])), x["stack"]))
    carried = each.select("_range", "_k", joined.alias("carry"))
    full = slim.join(carried, ["_range", "_k"])  # the carry stands on a range's rows as they pass
    full = full.withColumn("carry", F.when(F.row_number().over(Window.partitionBy("_range", "_k").orderBy(order)) == 1, F.col("carry")))

    def parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for batch in batches:
            found = []
            for r, k, level, title, carry in zip(batch["_range"], batch["_k"], batch["level"], batch["title"], batch["carry"]):
                if (r, k) != at:
                    at, stack = (r, k), [(s["level"], s["title"]) for s in carry]
                if pd.isna(level):
                    found.append([])
                else:
                    found.append([t for a, t in stack if a < level])
                    stack = _push(stack, int(level), title)
            yield pd.DataFrame({"_range": batch["_range"], "_k": batch["_k"], "_o": batch[order], "parents": found})

    kind = dict(entries.dtypes)[order]
    lined = full.repartition("_range").sortWithinPartitions("_range", "_k", order)
    out = lined.mapInPandas(parents, f"_range int, _k string, _o {kind}, parents array<string>")
    out = out.select("_range", "_k", F.col("_o").alias(order), "parents")
    return held.withColumn("_k", F.to_json("_g")).join(out, ["_range", "_k", order]).select(*entries.columns, "parents")
