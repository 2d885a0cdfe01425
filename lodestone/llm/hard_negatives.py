"""Hard negatives from a vector-approximation file.

Every dimension is cut into ``cells`` cells: their inner borders are quantiles of a bounded sample, their
outer ones the least and the greatest number of all rows. The file holds one byte a dimension for each
row. For an anchor a table gives the least and the greatest product that a cell allows, so a row's score
lies between two sums of looked-up numbers. A scan of the file alone keeps the rows whose bounds may
still reach the first ``positives`` of the anchor's label, and in a second scan those that may enter the
first ``negatives`` of a score window between two shares of a positive's score; only for these the vectors
are joined and scored exactly. A task's own bar thins out what it sends, the bar over all tasks decides.

Anchors come in slices of about ``slice_rows``; each slice is sent to all tasks (its size does not grow
with the table) and takes one scan of the file, so no vector moves but those of candidates. Of
rows that agree in label and vector only the first few by id stand in the file: no later copy
can come before them in any anchor's list. All of them are anchors if they are asked to be.

Defined results: rows with a null id, label or vector, with an empty vector, a null component, or one whose
products could leave a long take no part, nor do vectors of another length than most (ties: the longer);
rows that repeat an id all count, and an anchor leaves out its own row only; scores that are equal go to the smaller
id; fewer candidates than asked for are all returned; a negative or zero positive has the window that the inequalities give;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.draw import least
from lodestone.tables import cut, release

CELLS, SAMPLE_ROWS, SLICE_ROWS = 256, 4096, 2048
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
EVERY = 100
_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def usable(rows: DataFrame) -> DataFrame | None:
    """(row, vec_id, label, x) of the rows that take part, as a table; None if there are none."""
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return None
    most = isqrt((1 << 55) // sizes["dim"])  # a hundred times any score fits a long
    good = F.coalesce(F.forall("x", lambda c: c.isNotNull() & c.between(-most, most)), F.lit(False))
    rows = rows.filter((F.size("x") == sizes["dim"]) & good)
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x"), "negative-vectors")


def fit_cells(rows: DataFrame, dim: int, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner borders, least number, greatest number of each cell) by dimension; borders from at most ``sample_rows`` rows, extremes from all."""
    drawn = np.array([r["x"] for r in least(rows.select("x", "vec_id"), sample_rows, F.xxhash64("vec_id", "x"))], np.int64).reshape(-1, dim)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _matrix(b.column("x"), dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(x.min(0)), pa.array(x.max(0))], ["at", "lo", "hi"])

    ends = rows.select("x").mapInArrow(extremes, "at long, lo long, hi long").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("at").collect()  # a row a dimension
    inner = np.quantile(drawn, np.arange(1, cells) / cells, axis=0, method="inverted_cdf").astype(np.int64).T
    lo = np.concatenate([np.array([[r["lo"]] for r in ends]), inner + 1], axis=1)
    hi = np.concatenate([inner, np.array([[r["hi"]] for r in ends])], axis=1)
    return inner, lo, hi


def approximated(rows: DataFrame, inner: np.ndarray) -> DataFrame:
    """(row, label, code): a byte a dimension, the number of its cell."""
    dim = len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            code = np.stack([np.searchsorted(inner[d], x[:, d]) for d in range(dim)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), pa.array([c.tobytes() for c in code], pa.binary())], ["row", "label", "code"])

    return rows.select("row", "label", "x").mapInArrow(run, f"row long, label {dict(rows.dtypes)['label']}, code binary")


def _tables(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest product with each cell of each dimension, by dimension * cells + cell."""
    a, b = anchor[:, None] * lo, anchor[:, None] * hi
    return np.minimum(a, b).ravel(), np.maximum(a, b).ravel()


def _scan(codes: DataFrame, anchors: list[tuple], lo: np.ndarray, hi: np.ndarray, k: int, same_label: bool) -> DataFrame:
    """(anchor, of, row, low, high, sure): rows whose bounds may enter the first ``k`` of one of an anchor's windows.

    ``anchors`` are (row, label, vector, [(of, least score, greatest score)]); None for a score is no limit. A row is ``sure``
    if its bounds lie within the window; the ``k`` greatest low bounds of such rows raise the bar, over the batches of a task.
    """
    dim, cells = lo.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label, top = defaultdict(list), {}
        for row, label, x, windows in anchors:
            low, high = _tables(x, lo, hi)
            by_label[label].append((row, low, high, [(of, _NONE if a is None else a, np.iinfo(np.int64).max if z is None else z) for of, a, z in windows]))
        for b in batches:
            if not len(b):
                continue
            rows, labels = b.column("row").to_numpy(), b.column("label").to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), dim)
            place = code.astype(np.intp) + np.arange(dim) * cells
            found = []
            for label, those in by_label.items():
                met = np.flatnonzero((labels == label) == same_label)
                if not len(met):
                    continue
                own, at = rows[met], place[met]
                for row, low, high, windows in those:
                    least_score, most_score = low.take(at).sum(1), high.take(at).sum(1)
                    other = own != row
                    for of, first, last in windows:
                        sure = (least_score >= first) & (most_score <= last) & other
                        best = np.concatenate([top.get((row, of), np.empty(0, np.int64)), least_score[sure]])
                        top[row, of] = best = np.partition(best, len(best) - k)[len(best) - k :] if len(best) > k else best
                        bar = max(first, int(best.min())) if len(best) == k else first
                        i = np.flatnonzero((most_score >= bar) & (least_score <= last) & other)
                        found.append((np.full(len(i), row), np.full(len(i), of), own[i], least_score[i], most_score[i], sure[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["anchor", "of", "row", "low", "high", "sure"])

    return codes.mapInArrow(run, "anchor long, of long, row long, low long, high long, sure boolean")


def _first(found: list[DataFrame], rows: DataFrame, anchors: DataFrame, k: int, within: Column) -> DataFrame:
    """(anchor, of, rank, vec_id, score): the candidates that the bar over all tasks leaves, scored exactly; the first ``k`` of those ``within``."""
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    by_low = Window.partitionBy("anchor", "of").orderBy(F.desc("low"), "row")
    bars = met.filter("sure").withColumn("_n", F.row_number().over(by_low)).filter(F.col("_n") <= k)
    bars = bars.groupBy("anchor", "of").agg(F.min("low").alias("bar"), F.count("*").alias("_n")).filter(F.col("_n") == k).select("anchor", "of", "bar")
    left = met.join(bars, ["anchor", "of"], "left").filter("bar IS NULL OR high >= bar").select("anchor", "of", "row")
    scored = left.join(rows.select("row", "vec_id", "x"), "row").join(anchors.select(F.col("row").alias("anchor"), F.col("x").alias("ax")), "anchor")
    exact = F.aggregate(F.zip_with("x", "ax", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + p)
    scored = scored.select("anchor", "of", "row", "vec_id", exact.alias("score")).filter(within)
    best = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("anchor", "of", "rank", "vec_id", "score")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are (vec_id, label, x: whole numbers); ``is_anchor`` is over these. Negatives of a positive with score p have scores s with
    low * p <= 100 * s <= high * p and another label.
    """
    if not 2 <= cells <= 256:
        raise ValueError("a cell's number is a byte")
    schema = f"anchor_id {dict(rows.dtypes)['vec_id']}, positive_id {dict(rows.dtypes)['vec_id']}, rank int, negative_id {dict(rows.dtypes)['vec_id']}, positive_score long, negative_score long"
    none = rows.sparkSession.createDataFrame([], schema)
    table = usable(rows)
    some = table.first() if table is not None else None
    if some is None:
        return none
    inner, lo, hi = fit_cells(table, len(some["x"]), cells, sample_rows)
    copies = Window.partitionBy("label", "x").orderBy("vec_id", "row")
    heads = table.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= max(positives + 1, negatives))
    codes = cut(approximated(heads, inner), "approximation")
    anchors = table.filter(is_anchor)
    slices = -(-anchors.count() // slice_rows)
    part = lambda i: F.pmod(F.xxhash64("row"), F.lit(slices)) == i
    vector = lambda r: np.array(r["x"], np.int64)
    near = []
    for i in range(slices):
        asked = [(r["row"], r["label"], vector(r), [(0, None, None)]) for r in anchors.filter(part(i)).select("row", "label", "x").collect()]  # about slice_rows
        near.append(cut(_scan(codes, asked, lo, hi, positives, True), "positive-candidates"))
    if not near:
        return none
    found = _first(near, table, anchors, positives, F.lit(True)).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = cut(found, "positives")
    release(*near)
    far, wanted = [], found.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))  # `positives` a group
    for i in range(slices):
        each = anchors.filter(part(i)).join(wanted, F.col("row") == F.col("anchor")).select("row", "label", "x", "scores").collect()
        asked = [(r["row"], r["label"], vector(r), [(p, -(-low * p // 100), high * p // 100) for p in sorted(r["scores"]) if -(-low * p // 100) <= high * p // 100]) for r in each]
        far.append(cut(_scan(codes, [a for a in asked if a[3]], lo, hi, negatives, False), "negative-candidates"))
    within = (F.col("of") * low <= 100 * F.col("score")) & (100 * F.col("score") <= F.col("of") * high)
    hard = _first(far, table, anchors, negatives, within)
    out = found.join(hard, (found["anchor"] == hard["anchor"]) & (found["positive_score"] == hard["of"])).drop(hard["anchor"])
    out = out.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """Whole components of 256ths, labels moved on where the id is divisible by 7; anchors are the ids divisible by 100."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = embeddings.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(256 * c)).alias("x"))
    return mine(rows, F.col("vec_id") % EVERY == 0)
