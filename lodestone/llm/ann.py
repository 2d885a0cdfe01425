"""Approximate nearest neighbours from a permutation index.

Pivots are drawn from a bounded sample. A vector is represented by its ``prefix`` nearest pivots
in order; every vector is posted, with the place that the pivot has in its order, in the
inverted files of these pivots. A query looks into the files of its own pivots and ranks
the vectors found there by the footrule distance of the truncated orders, where a pivot that one of the
two lacks stands behind its last place. The first ``share`` of a block's vectors, ``fewest`` of them at
least, are reranked by exact distance on the original vectors.

The index is kept in blocks of about ``block_rows`` vectors by a hash of id and vector, and the
stated queries in blocks of ``query_rows``; each block of queries meets each block of the index
once, and every meeting returns k rows a query. So memory is bounded and work is even,
whatever the data look like. Equal footrules and equal distances go to the smaller id.

Defined results: vectors that are null, all zero, of another length than most pivots', or
hold null or non-finite components take no part, nor do rows without id; rows that
repeat an id all count, each under a number of its own: a query leaves out its own row only, and
each query row has its own k results; extra columns are ignored; fewer than k candidates
are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.draw import least
from lodestone.tables import cut, release

PIVOTS, PREFIX, SHARE, LEAST = 256, 96, 0.12, 200
SAMPLE_ROWS, BLOCK_ROWS, QUERY_ROWS = 4096, 4096, 1024
EVERY, K = 100, 10


def usable(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.transform(vec, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False)))


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Pivots from at most ``sample_rows`` rows: distinct vectors, each in turn drawn far from those before."""
    drawn = [r["v"] for r in least(rows.select("v", "vec_id"), sample_rows, F.xxhash64("vec_id", "v"))]
    if not drawn:
        return np.empty((0, 0))
    dim = max(set(map(len, drawn)), key=[len(v) for v in drawn].count)
    x = np.unique(np.array([v for v in drawn if len(v) == dim]), axis=0)
    random = np.random.default_rng(7)
    picked = [int(random.integers(len(x)))]
    d = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < min(pivots, len(x)):
        picked.append(int(random.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def _orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first, ties to the smaller number."""
    d = (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int32)


def indexed(rows: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """``rows`` with ``places``: their pivots in order."""
    dim = pivots.shape[1] if pivots.size else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("v").offsets.to_numpy())
            b = b.filter(pa.array(size == dim))
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1))
            order = _orders(x, pivots, prefix) if b.num_rows else np.empty((0, 1), np.int32)
            width = order.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(order) * width + 1, width), pa.int32()), pa.array(order.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "places"])

    return rows.mapInArrow(run, "row long, vec_id long, v array<double>, places array<int>")


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def _meet(keys: np.ndarray, ids: np.ndarray, x: np.ndarray, order: np.ndarray, qkeys: np.ndarray, q: np.ndarray, qorder: np.ndarray, k: int, share: float, fewest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k nearest of a block among its first candidates: (row of the query, ids, squared distances)."""
    by_id = np.argsort(ids, kind="stable")
    if (np.diff(ids[by_id]) == 0).any():  # rows of one id stand in the order of their vectors
        by_id = np.lexsort((*x.T[::-1], ids))
    keys, ids, x, order = keys[by_id], ids[by_id], x[by_id], order[by_id]
    n, width = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    rows, places = (by_pivot // width).astype(np.int32), (by_pivot % width).astype(np.int32)
    starts = np.searchsorted(flat[by_pivot], np.arange(flat.max() + 2))
    take, out = min(n, max(fewest, int(np.ceil(share * n)))), []
    for i in range(len(qkeys)):
        shared = np.zeros(n, np.int32)
        for place, p in enumerate(qorder[i]):
            if p < len(starts) - 1:
                a, b = starts[p], starts[p + 1]
                shared[rows[a:b]] += 2 * (width - np.maximum(places[a:b], place))
        # footrule = width * (width + 1) - shared; of equal ones the smaller id, which stands first
        if take < n:
            bar = np.partition(shared, n - take)[n - take]
            sure = np.flatnonzero(shared > bar)
            first = np.concatenate([sure, np.flatnonzero(shared == bar)[: take - len(sure)]])
        else:
            first = np.arange(n)
        first = first[keys[first] != qkeys[i]]
        d = ((x[first] - q[i]) ** 2).sum(1)
        best = np.lexsort((ids[first], d))[:k]
        out.append((np.full(len(best), qkeys[i]), ids[first][best], d[best]))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K, share: float = SHARE, fewest: int = LEAST, pivots: int = PIVOTS, prefix: int = PREFIX, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``vectors`` that ``is_query`` (over ``vec_id``) picks."""
    rows = cut(usable(vectors, vec, key).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    index = cut(indexed(rows, fit_pivots(rows, pivots), prefix), "permutations")
    release(rows)
    n, m = index.count(), index.filter(is_query).count()
    blocks, sides = max(1, n // BLOCK_ROWS), max(1, m // QUERY_ROWS)
    part = lambda count: F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = index.withColumn("block", part(blocks)).withColumn("side", every(sides))
    asked = index.filter(is_query).withColumn("side", part(sides)).withColumn("block", every(blocks))
    # names of their own: of columns that both sides share, Spark may prune the right side's
    asked = asked.select("block", "side", F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("places").alias("query_places"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = _meet(left["row"].to_numpy(), left["vec_id"].to_numpy(), _matrix(left["v"], float), _matrix(left["places"], np.int32), right["query"].to_numpy(), _matrix(right["q"], float), _matrix(right["query_places"], np.int32), k, share, fewest)
        q, v, d = (np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3))
        ids = dict(zip(right["query"].to_pylist(), right["query_id"].to_pylist())) if found else {}
        return pa.table({"query": pa.array(q.astype(np.int64)), "query_id": pa.array([ids[x] for x in q.astype(np.int64).tolist()], pa.int64()), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(np.sqrt(d.astype(float)))})

    met = data.groupBy("block", "side").cogroup(asked.groupBy("block", "side")).applyInArrow(run, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The ten nearest found for every vector whose id is divisible by 100."""
    return search(embeddings, F.col("vec_id") % EVERY == 0)
