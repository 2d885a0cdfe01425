"""Vector recall from coarse cells that are stored beside the vectors.

Centroids are trained on a bounded sample of unit vectors; every vector is laid out in the folder of its nearest
one, and each cell's centroid, radius (the farthest of its members) and size become a small table. A
question visits its nearest cells until these hold ``num_candidates`` rows that pass the filter, and only
the folders of visited cells are read. The radius bounds what any member of a cell can score, so in exact mode a
second visit goes to just those cells whose bound reaches the k-th score, and the answer is that of a whole scan.

Rows without a vector, zero vectors and vectors of another length than most of the sample take no part. A cell that holds a great share of the
rows is written and read in many files and tasks; no group of a cell's rows is ever gathered.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.vectors import present
from lodestone.operators.nearest import blocks, in_order, matrix, scored, sized
from lodestone.operators.ranking import top_k

#: Cells at most, sampled vectors for each of them, rounds of training.
MOST_CELLS, SAMPLED, TRAINING = 4096, 32, 8
#: Rounding that two ways of computing a distance may differ by.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))


def trained(x: np.ndarray, cells: int, rounds: int = TRAINING) -> np.ndarray:
    """At most ``cells`` centroids of unit vectors, by k-means from distinct starts."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(7).permutation(len(x))[:cells]]
    for _ in range(rounds if len(centres) < len(x) else 0):
        own = _distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class VectorCells:
    """An index under ``path``: ``vectors`` in a folder a cell, ``cells`` with a row each."""

    def __init__(self, spark: SparkSession, path: str, key: str = "hash_id"):
        self.key, self.rows = key, spark.read.parquet(f"{path}/vectors")
        table = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # at most MOST_CELLS rows
        self.numbers, self.sizes, self.radii = ([r[c] for r in table] for c in ("cell", "n", "radius"))
        self.centres = np.array([r["centre"] for r in table], float).reshape(len(table), -1)

    @classmethod
    def build(cls, points: DataFrame, path: str, key: str = "hash_id", cells: int | None = None) -> VectorCells:
        """Trains and writes; ``points`` (key, vector, and what filters ask for) keep their columns."""
        spark, held = points.sparkSession, points.filter(present(F.col("vector")))
        n = held.count()
        if not n:
            raise ValueError("there is no vector to index")
        cells = min(cells or round(n**0.5), MOST_CELLS, n)
        drawn = held.select(key, "vector").orderBy(F.xxhash64(key), key).limit(SAMPLED * cells).collect()  # bounded by MOST_CELLS
        dim = max((c := Counter(len(r["vector"]) for r in drawn)), key=lambda d: (c[d], d), default=0)
        x = _unit(np.array([r["vector"] for r in drawn if len(r["vector"]) == dim], float).reshape(-1, dim))
        centres = trained(x[x.any(1)], max(cells, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(sized(b.column("vector"), dim)))
                x = _unit(matrix(b.column("vector"), dim))
                good = np.isfinite(x).all(1) & x.any(1)
                b, x = b.filter(pa.array(good)), x[good]
                if len(b) and len(centres):
                    d = _distances(x, centres)
                    own = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], [*b.schema.names, "cell", "gap"])

        schema = ", ".join(f"`{c}` {t}" for c, t in held.dtypes) + ", cell int, gap double"
        dealt = held.mapInArrow(run, schema).hint("rebalance", "cell")  # a large cell is split over tasks, small ones share one
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        written = spark.read.schema(schema).parquet(f"{path}/vectors")
        known = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        sizes = written.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
        sizes.join(F.broadcast(known), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path, key)

    def _sizes(self, where: Column | None) -> np.ndarray:
        """Rows of each cell that pass the filter."""
        if where is None:
            return np.array(self.sizes, np.int64)
        found = {r["cell"]: r["n"] for r in self.rows.filter(where).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        return np.array([found.get(c, 0) for c in self.numbers], np.int64)

    def _visit(self, asked: DataFrame, query: str, names: list[tuple], q: np.ndarray, visits: np.ndarray, k: int, where: Column | None) -> DataFrame:
        """(query, key, score): the ``k`` best of each question and batch, among the cells that ``visits`` (questions by cells) marks."""
        wanted = [self.numbers[i] for i in np.flatnonzero(visits.any(0))]
        rows = self.rows.filter(F.col("cell").isin(wanted) if wanted else F.lit(False))
        rows = (rows if where is None else rows.filter(where)).select(self.key, "vector", "cell")
        asking: dict[int, np.ndarray] = {c: np.flatnonzero(visits[:, i]) for i, c in enumerate(self.numbers) if visits[:, i].any()}
        key, dim, kind = self.key, q.shape[1], to_arrow_type(asked.schema[query].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                b = in_order(b, key)
                x, cell, found = matrix(b.column("vector"), dim), b.column("cell").to_numpy(), defaultdict(list)
                for c in np.unique(cell).tolist():
                    own, who = np.flatnonzero(cell == c), asking[c]
                    i, j, s = scored(x[own], q[who], k, True)
                    for name, values in (("row", own[i]), ("who", who[j]), ("score", s)):
                        found[name].append(values)
                row, who, score = (np.concatenate(found[n]) for n in ("row", "who", "score"))
                yield pa.RecordBatch.from_arrays([pa.array([names[w][0] for w in who.tolist()], kind), b.column(key).take(pa.array(row)), pa.array(score)], [query, key, "score"])

        return rows.mapInArrow(run, f"{query} {dict(asked.dtypes)[query]}, {key} {dict(rows.dtypes)[key]}, score double")

    def search(self, questions: DataFrame, k: int, num_candidates: int | None = 100, where: Column | None = None, query: str = "query_id") -> DataFrame:
        """(query, key, score, rank) by (1 + cosine) / 2, ties to the smaller key; ``num_candidates`` None is exact."""
        asked = questions.filter(present(F.col("vector"))).select(query, "vector")
        sizes, found = self._sizes(where), []
        for names, q in blocks(asked, [query]):
            if not names or not len(self.numbers) or q.shape[1] != self.centres.shape[1]:
                continue
            unit = _unit(q)
            d = _distances(unit, self.centres)
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            enough = (held - sizes[order] < max(k, num_candidates or 0)) & (sizes[order] > 0) & unit.any(1)[:, None]
            visits = np.zeros(d.shape, bool)
            np.put_along_axis(visits, order, enough, axis=1)
            first = self._visit(asked, query, names, q, visits, k, where)
            found.append(first)
            if num_candidates is None:
                place = {n[0]: i for i, n in enumerate(names)}
                bar = np.full(len(names), -np.inf)
                for r in top_k(first, k, query, tie=self.key).filter(F.col("rank") == k).select(query, "score").collect():  # a row a question of the block
                    bar[place[r[query]]] = r["score"]
                gap = np.maximum(d - np.array(self.radii)[None, :] - SLACK, 0)
                reach = (2 - gap**2 / 2) / 2 + SLACK  # the best score of a member
                more = ~visits & (reach >= bar[:, None]) & (sizes > 0)[None, :] & unit.any(1)[:, None]
                found.append(self._visit(asked, query, names, q, more, k, where))
        if not found:
            return questions.sparkSession.createDataFrame([], f"{query} {dict(asked.dtypes)[query]}, {self.key} {dict(self.rows.dtypes)[self.key]}, score double, rank int")
        return top_k(reduce(DataFrame.unionByName, found), k, query, tie=self.key).select(query, self.key, "score", "rank")
