"""Exact nearest rows: a bounded block of asked vectors meets every Arrow batch of points in one matrix product.

More questions than one block holds are asked block by block, each in a pass of its own over the points. Points
whose vectors have another length than the asked ones take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.vectors import present
from lodestone.operators.ranking import TIES, top_k
from lodestone.tables import cut

#: Numbers in a block of asked vectors, which is sent to all executors (32 MB).
SENT_NUMBERS = 4_000_000
#: Asked vectors that meet a batch at once.
COLUMNS = 256
#: What two orders of summation may differ in, of the lengths of both vectors, and more than places that tie.
SLACK = 1e-10


def sized(column: pa.Array, dim: int) -> np.ndarray:
    """Which of a batch's vectors have ``dim`` numbers."""
    return np.array(pc.fill_null(pc.list_value_length(column), -1)) == dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors of ``dim`` numbers, a row each; a null among them counts as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def blocks(asked: DataFrame, keys: list[str]) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """(keys, vectors as a matrix) of all asked rows, in blocks of about ``SENT_NUMBERS`` numbers by a hash of the keys."""
    size = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    if size["lo"] != size["hi"]:
        raise ValueError(f"asked vectors have {size['lo']} to {size['hi']} numbers")
    n = max(1, -(-size["numbers"] // max(1, SENT_NUMBERS)))
    held = asked.select(*keys, "vector")
    held = cut(held, "asked-vectors") if n > 1 else held
    empty = True
    for i in range(n):
        rows = (held.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) if n > 1 else held).collect()
        if not rows and not (empty and i == n - 1):
            continue
        empty = False
        yield [tuple(r[k] for k in keys) for r in rows], np.array([r["vector"] for r in rows], float).reshape(len(rows), size["hi"] or 0)


def scores(x: np.ndarray, q: np.ndarray, cosine: bool) -> np.ndarray:
    """The score of each row of ``x`` for each row of ``q``, not rounded: the inner product, or (1 + cosine) / 2; NaN without a cosine."""
    s = x @ q.T
    if cosine:
        size = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((q**2).sum(1))[None, :]
        s = (1 + np.divide(s, size, out=np.full_like(s, np.nan), where=size > 0)) / 2
    return s


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` greatest of each column of ``s``, of equal ones the first; NaN is no score."""
    s = np.where(np.isnan(s), -np.inf, s)
    bar = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)]
    rows, columns = [], []
    for j in range(s.shape[1]):
        i = np.flatnonzero((s[:, j] >= bar[j]) & (s[:, j] > -np.inf))
        if len(i) > k:
            i = i[np.argsort(-s[i, j], kind="stable")[:k]]
        rows.append(i)
        columns.append(np.full(len(i), j))
    return np.concatenate(rows), np.concatenate(columns)


def scored(x: np.ndarray, q: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``x``, rows of ``q``, scores) of the ``k`` best for each row of ``q``, of equal ones the first.

    The last bits of a matrix product hang on the shape of the batch. It picks those that can be among the best, and
    their scores are summed anew, row by row, so that equal vectors have equal scores whatever stands beside them.
    """
    s = scores(x, q, cosine)
    s = np.where(np.isnan(s), -np.inf, s)
    wide = np.ones(len(q)) if cosine else np.sqrt((x**2).sum(1)).max(initial=0) * np.sqrt((q**2).sum(1))
    bar = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)] - np.where(np.isfinite(wide), SLACK * wide, 0)
    rows, columns, found = [], [], []
    for j in range(len(q)):
        i = np.flatnonzero((s[:, j] >= bar[j]) & (s[:, j] > -np.inf))
        own = (x[i] * q[j]).sum(1)
        if cosine:
            own = (1 + own / (np.sqrt((x[i] ** 2).sum(1)) * np.sqrt((q[j] ** 2).sum()))) / 2
        own = np.round(own, TIES)
        if len(i) > k:
            first = np.argsort(-own, kind="stable")[:k]
            i, own = i[first], own[first]
        rows.append(i)
        columns.append(np.full(len(i), j))
        found.append(own)
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(found)


def in_order(b: pa.RecordBatch, name: str) -> pa.RecordBatch:
    return b.take(pa.array(np.argsort(b.column(name).to_numpy(zero_copy_only=False), kind="stable")))


def nearest(points: DataFrame, asked: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), ids: tuple[str, ...] = ("hash_id",), raw_dot: bool = False) -> DataFrame:
    """(keys, ids, score, rank): per asked row the ``k`` points with the greatest score; ties go to the smaller last id.

    Rows without a vector take no part, nor do zero vectors where the score is a cosine.
    """
    keys, ids = list(keys), list(ids)
    points = points.filter(present(F.col("vector"))).select(*ids, "vector")
    asked = asked.filter(present(F.col("vector"))).select(*keys, "vector")
    types = dict(asked.dtypes) | dict(points.dtypes)
    kinds = [to_arrow_type(asked.schema[k].dataType) for k in keys]
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, *ids)) + ", score double"

    def asking(names: list[tuple], q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(sized(b.column("vector"), q.shape[1])))
                if not len(b) or not names:
                    continue
                b = in_order(b, ids[-1])
                x, rows, at, found = matrix(b.column("vector"), q.shape[1]), [], [], []
                for first in range(0, len(q), COLUMNS):
                    i, j, s = scored(x, q[first : first + COLUMNS], k, not raw_dot)
                    rows.append(i)
                    at.append(first + j)
                    found.append(s)
                take, who = np.concatenate(rows), np.concatenate(at)
                arrays = [pa.array([names[w][n] for w in who.tolist()], kinds[n]) for n in range(len(keys))]
                arrays += [b.column(c).take(pa.array(take)) for c in ids] + [pa.array(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, *ids, "score"])

        return points.mapInArrow(run, schema)

    return top_k(reduce(DataFrame.unionByName, [asking(*held) for held in blocks(asked, keys)]), k, keys, tie=ids[-1])


def scaled(points: DataFrame, asked: DataFrame, key: str = "query_id", point: str = "hash_id") -> DataFrame:
    """(key, point, dense): inner products, scaled per asked row from their least to their greatest; no vector counts 0, all equal gives 0.

    Two passes over the points a block of questions: the first gives the spans (a row for each asked one and batch).
    """
    kind, arrow = dict(asked.dtypes)[key], to_arrow_type(asked.schema[key].dataType)
    some = points.select(point, "vector")

    def asking(names: list[tuple], q: np.ndarray) -> DataFrame:
        def raw(b: pa.RecordBatch) -> np.ndarray:
            out, held = np.zeros((len(b), len(q))), sized(b.column("vector"), q.shape[1])
            if held.any():
                out[held] = matrix(b.column("vector").filter(pa.array(held)), q.shape[1]) @ q.T
            return out

        def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b) and names:
                    s = raw(b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(s.min(0)), pa.array(s.max(0))], ["i", "lo", "hi"])

        spans = {r["i"]: (r["lo"], r["hi"]) for r in some.mapInArrow(span, "i long, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        lo, hi = (np.array([spans.get(i, (0.0, 0.0))[e] for i in range(len(q))]) for e in (0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b) or not names:
                    continue
                s = np.where(hi > lo, (raw(b) - lo) / np.where(hi > lo, hi - lo, 1.0), 0.0)
                who = pa.array([x[0] for x in names], arrow).take(pa.array(np.tile(np.arange(len(q)), len(b))))
                yield pa.RecordBatch.from_arrays([who, b.column(point).take(pa.array(np.repeat(np.arange(len(b)), len(q)))), pa.array(s.ravel())], [key, point, "dense"])

        return some.mapInArrow(run, f"{key} {kind}, {point} {dict(points.dtypes)[point]}, dense double")

    return reduce(DataFrame.unionByName, [asking(*held) for held in blocks(asked.select(key, "vector"), [key])])
