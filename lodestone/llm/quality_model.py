"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade 0..G. One weight vector over hashed text features is shared by all
grades; ordered thresholds split its score s: P(grade <= g) = logistic(threshold_g - s). Features
are the presence of hashed lower-case words and of bins of four whole-text shares (repeated
word triples, symbols, capitals, exclamation marks). From the model come the expected grade and
the tail probability P(grade >= good), by which documents are selected.

The fit uses at most ``sample_rows`` labelled documents, those with the least hash of their
id, and proximal descent with an L1 penalty on a growing set of words until no direction's slope exceeds ``TOLERANCE``
(it raises if ``STEPS`` do not suffice), in a fixed order: reruns agree. Scoring reads every document in full.

The grade of the tables' labels: 0 for low quality, 1 for good but toxic text, 2 for good
clean text. Defined results: null text is empty; labels without a document, null labels and
null ids are not learnt from; of several labels of a document the lowest counts; without any label
all grades are equally likely; repeated rows are scored alike; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.draw import least
from lodestone.tables import cut, release
from lodestone.llm.wordhash import hashed, run_hashes

BITS, BINS = 18, 24
SHARES = 4
DIM = (1 << BITS) + SHARES * BINS
SAMPLE_ROWS = 10_000
GRADES, GOOD, LEAST_TAIL = 3, 2, 0.5
L1, MIN_DOCS = 5e-4, 3
#: Slope that may be left in any direction when the fit ends; steps and rounds after which it gives up; words that a round adds at least.
TOLERANCE, STEPS, ROUNDS, LEAST_NEW = 2e-4, 20_000, 60, 64


def grade(quality: Column, toxic: Column) -> Column:
    """The grade of a row of labels."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(toxic == 0, 2)


def _shares(text: bytes, words: np.ndarray) -> list[float]:
    triples = run_hashes(words, 3)
    size = max(1, len(text))
    count = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    repeated = 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0
    return [repeated, 4 * count(b"#*$%&|<>"), 2 * count(bytes(range(65, 91))), 8 * count(b"!")]


def features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted numbers of the features that each text has."""
    for first, words, at in hashed(texts, lower=True):
        for i in range(len(at) - 1):
            own = words[at[i] : at[i + 1]]
            bins = [min(BINS - 1, int(x * BINS)) + k * BINS + (1 << BITS) for k, x in enumerate(_shares(texts[first + i] or b"", own))]
            yield np.concatenate([np.unique(own >> np.uint64(64 - BITS)).astype(np.int64), bins])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1..G, one column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _loss(s: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood of scores and thresholds, and its slopes by both."""
    levels, n = len(thresholds) + 1, len(s)
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    hi, lo = (_sigmoid(edges[grades + k] - s) for k in (1, 0))
    hi, lo = np.where(grades == levels - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
    chance = np.maximum(hi - lo, 1e-300)
    dhi, dlo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
    gt = np.array([(np.where(grades == k + 1, dlo, 0) - np.where(grades == k, dhi, 0)).sum() / n for k in range(levels - 1)])
    return -np.log(chance).mean(), (dhi - dlo) / n, gt


def _ordered(t: np.ndarray) -> np.ndarray:
    """The nearest numbers that do not fall: neighbours that do are pooled."""
    pools: list[list[float]] = []
    for v in t.tolist():
        pools.append([v])
        while len(pools) > 1 and np.mean(pools[-2]) > np.mean(pools[-1]):
            last = pools.pop()
            pools[-1] += last
    return np.array([np.mean(x) for x in pools for _ in x])


def _slopes(w: np.ndarray, thresholds: np.ndarray, g: np.ndarray, gt: np.ndarray) -> np.ndarray:
    """What is left to descend in the direction of each weight, with its penalty, and of each threshold, within their order."""
    left = np.where(w != 0, np.abs(g + L1 * np.sign(w)), np.maximum(np.abs(g) - L1, 0))
    return np.concatenate([left, np.abs(thresholds - _ordered(thresholds - gt))])


def _descend(x: np.ndarray, grades: np.ndarray, w: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the columns of ``x`` and thresholds where no direction's slope exceeds half the tolerance.

    Accelerated proximal descent: steps are scaled by each column's share in the rows' sizes, shortened
    until the loss lies under its quadratic bound, and the pace starts anew where it would go uphill.
    """
    p = len(w)
    size = x.sum(1) + 2.0
    scale = np.concatenate([np.maximum(x.T @ size / len(x), 1e-12), np.full(len(thresholds), size.mean())])
    penalty = np.concatenate([np.full(p, L1), np.zeros(len(thresholds))])
    z = y = np.concatenate([w, thresholds])
    pace, bend = 1.0, 0.05
    for _ in range(STEPS):
        at, gs, gt = _loss(x @ y[:p], y[p:], grades)
        g = np.concatenate([gs @ x, gt])
        bend *= 0.95
        while True:
            step = y - g / (bend * scale)
            new = np.sign(step) * np.maximum(np.abs(step) - penalty / (bend * scale), 0)
            new[p:] = _ordered(step[p:])
            d = new - y
            there, gs, gt = _loss(x @ new[:p], new[p:], grades)
            if there <= at + g @ d + 0.5 * bend * (scale * d * d).sum() + 1e-12:
                break
            bend *= 2
        left = _slopes(new[:p], new[p:], gs @ x, gt)
        if left.max() < TOLERANCE / 2:
            return new[:p], new[p:]
        if (y - new) @ (scale * (new - z)) > 0:
            pace, y = 1.0, new
        else:
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            y = new + (pace - 1) / faster * (new - z)
            y[p:] = _ordered(y[p:])
            pace = faster
        z = new
    raise RuntimeError(f"the fit is not flat to {TOLERANCE / 2} after {STEPS} steps: {left.max():.2g}")


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int = GRADES) -> Model:
    """Maximum likelihood with an L1 penalty on the weights; thresholds start at the grades' shares and stay ordered."""
    counts = np.bincount(grades, minlength=levels) + 1.0
    share = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(share / (1 - share))
    weights = np.zeros(DIM)
    if not rows:
        return Model(weights, thresholds)
    flat = np.concatenate(rows)
    used, column = np.unique(flat, return_inverse=True)
    often = np.bincount(column) >= MIN_DOCS
    size = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    keep = often[column]
    new = np.cumsum(often) - 1
    column, owner = new[column[keep]], owner[keep]
    n, w = len(rows), np.zeros(int(often.sum()))
    for _ in range(ROUNDS):
        _, gs, gt = _loss(np.bincount(owner, weights=w[column], minlength=n), thresholds, grades)
        g = np.bincount(column, weights=gs[owner], minlength=len(w))
        left = _slopes(w, thresholds, g, gt)
        if left.max() < TOLERANCE:
            weights[used[often]] = w
            return Model(weights, thresholds)
        left = left[: len(w)]
        # the words that carry weight, and as many of the others whose slopes are the steepest
        held = np.flatnonzero(w)
        steep = np.argsort(-np.where(w != 0, -1, left), kind="stable")[: max(LEAST_NEW, len(held))]
        some = np.union1d(held, steep[left[steep] > 0])
        place = np.full(len(w), -1)
        place[some] = np.arange(len(some))
        within = place[column] >= 0
        x = np.zeros((n, len(some)))
        x[owner[within], place[column[within]]] = 1
        w[some], thresholds = _descend(x, grades, w[some], thresholds)
    raise RuntimeError(f"the fit is not flat to {TOLERANCE} after {ROUNDS} rounds: {left.max():.2g}")


def train(docs: DataFrame, rated: DataFrame, sample_rows: int = SAMPLE_ROWS, levels: int = GRADES) -> Model:
    """The model from ``rated`` (doc_id, grade) and the texts of at most ``sample_rows`` of its documents."""
    few = rated.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    few = docs.sparkSession.createDataFrame(least(few, sample_rows, F.xxhash64("doc_id")), few.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f.astype("<i4").tobytes() for f in features(b.column("text").cast(pa.large_binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(rows, pa.binary())], ["doc_id", "grade", "f"])

    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most sample_rows short rows
    rows = found.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, f binary")
    rows = cut(rows, "rated-features")
    picked = least(rows, sample_rows, F.xxhash64("doc_id", "f"))  # fewer than there are only where documents repeat an id
    release(rows)
    rows = sorted(picked, key=lambda r: (r["doc_id"], r["f"]))
    return fit([np.frombuffer(r["f"], "<i4").astype(np.int64) for r in rows], np.array([r["grade"] for r in rows], np.int64), levels)


def score(docs: DataFrame, model: Model, good: int = GOOD, least_tail: float = LEAST_TAIL) -> DataFrame:
    """Per row of ``docs``: doc_id, expected_grade, tail_probability, selected."""
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for b in batches:
            s = np.array([weights[f].sum(dtype=np.float64) for f in features(b.column("text").cast(pa.large_binary()).to_pylist())])
            above = own.above(s) if len(s) else np.empty((0, len(thresholds)))
            tail = above[:, good - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(above.sum(1)), pa.array(tail), pa.array(tail >= least_tail)], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels``, score all ``documents``."""
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(documents, train(documents, rated))
