"""Substring dedup by seed and extend: later copies of long passages are removed.

Seeds are winnowed anchors: of the 26 runs of 25 words in each window of 50 words the one
with the least hash. Windows with equal words have equal anchors, so a join of the
documents on anchors misses no repeated window, and anchors that a single document has
drop out at once. A match is extended from the anchor both ways: the neighbouring windows
that hold it make up one span, 50 to 75 words, which is what two documents can share around it.
Spans that are equal as a whole, one row each, settle all their windows at once: every document but
the first loses them. Only where one anchor stands in unlike spans, at the ends of a passage, the
extension goes window by window: those of one document a span are held against each other, and each
window looks for the smallest document that has it. Spans and windows that follow one another
merge into maximal repeats, which are cut out. Extending against every other document in turn would
square a large group of copies; so the work is in proportion to the text.

Two windows count as equal if their 64-bit hashes are. Defined results: null text has no
words; rows that repeat a doc_id are judged each on its own and do not remove one another's
words; rows without doc_id neither remove words nor lose any; columns beyond ``doc_id`` and
``text`` are ignored; texts shorter than a window stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.wordhash import hashed, run_hashes, span_hashes
from lodestone.tables import cut, owned, release

WINDOW, SEED_WORDS = 50, 25


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _binary(column) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def anchors(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """(doc_id, anchors): the distinct anchors of each document that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, words, at in hashed(_binary(b.column("text"))):
                least = _least(run_hashes(words, seed), window - seed + 1).view(np.int64) if len(words) >= window else np.empty(0, np.int64)
                found += [np.unique(least[lo : max(lo, hi - window + 1)]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "anchors"])

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, anchors array<long>")


def _text_without(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, bytes]:
    """(words covered by the windows at ``starts``, the others joined by a space)."""
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    keep = np.cumsum(step)[:-1] == 0
    return len(words) - int(keep.sum()), b" ".join(compress(words, keep))


def _spans(anchors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of ``starts``, number) of the runs of neighbouring windows with one anchor."""
    edge = np.flatnonzero((np.diff(starts) != 1) | (np.diff(anchors) != 0)) + 1
    first = np.concatenate([[0], edge])
    return first, np.diff(np.concatenate([first, [len(starts)]]))


def _candidates(joined: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows whose spans must be compared keep ``text``, ``spans`` and the hashes of their windows; the others are done."""
    span = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64()), ("span", pa.int64())])
    schema = "doc_id long, n_words long, kept_sha256 string, text string, spans array<struct<start:int,n:int,off:int,anchor:long,span:long>>, hashes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = _binary(b.column("text")), []
            shared = b.column("shared")
            some = [i for i in range(len(texts)) if shared[i].is_valid]
            pick: dict[int, tuple[list[dict], np.ndarray]] = {}
            for first, words, at in hashed([texts[i] for i in some]):
                if len(words) < window:
                    continue
                anchors, whole = _least(run_hashes(words, seed), window - seed + 1).view(np.int64), run_hashes(words, window).view(np.int64)
                for j in range(len(at) - 1):
                    i, lo, hi = some[first + j], at[j], max(at[j], at[j + 1] - window + 1)
                    hit = np.flatnonzero(np.isin(anchors[lo:hi], shared[i].values.to_numpy(zero_copy_only=False)))
                    if len(hit):
                        own = anchors[lo:hi][hit]
                        off, n = _spans(own, hit)
                        start = hit[off]
                        keys = span_hashes(words[lo : at[j + 1]], start, start + n + window - 1).view(np.int64)
                        pick[i] = [dict(zip(("start", "n", "off", "anchor", "span"), x, strict=True)) for x in zip(start.tolist(), n.tolist(), off.tolist(), own[off].tolist(), keys.tolist(), strict=True)], whole[lo:hi][hit]
            for i, t in enumerate(texts):
                words = (t or b"").split()
                if i in pick:
                    out.append((len(words), None, t, *pick[i]))
                else:
                    out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None, None, None))
            n, sha, text, spans, hashes = zip(*out, strict=True) if out else ([],) * 5
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span)), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "kept_sha256", "text", "spans", "hashes"])

    return joined.mapInArrow(run, schema)


def _ends(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """(span, windows): the windows, by their place in the span, that a document before the span's first also has; for spans whose anchor stands in others, too."""
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    wanted = kinds.join(mixed, "anchor", "left_semi").groupBy(F.col("rep.row").alias("row")).agg(F.collect_list(F.struct("rep.at", "span", "first")).alias("asked"))
    each = found.select("row", "spans", "hashes").join(cut(wanted, "open-spans"), "row").select("spans", "hashes", F.explode("asked").alias("a"))
    own = F.get("spans", F.col("a.at"))
    windows = each.select("a.span", "a.first", F.posexplode(F.slice("hashes", own["off"] + 1, own["n"])).alias("j", "hash"))
    windows = cut(windows, "end-windows")
    least = windows.groupBy("hash").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").select("hash", "least")
    least = cut(least, "first-windows")  # as a table, so that the join's very common windows can be split
    hit = windows.join(least, "hash").filter("first > least")
    return hit.groupBy("span").agg(F.collect_list("j").alias("windows"))


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """A row for each row of ``docs``: row, doc_id, n_words, kept_sha256 (if nothing can be removed), text, removed.

    ``removed`` are the starts of the windows that a document with a smaller id also has.
    """
    keep: list[DataFrame] = []
    with owned(keep):
        seeds = cut(anchors(docs, window, seed), "anchors")
        posted = seeds.select("doc_id", F.explode("anchors").alias("anchor"))
        shared = posted.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
        own = cut(posted.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared")), "shared-anchors")
        release(seeds)
        joined = docs.select("doc_id", "text").join(own, "doc_id", "left")
        found = cut(_candidates(joined, window, seed).withColumn("row", F.monotonically_increasing_id()), "spans")
        release(own)
        each = found.filter("spans IS NOT NULL").select("row", "doc_id", F.posexplode("spans").alias("at", "s")).select("row", "doc_id", "at", "s.start", "s.n", "s.anchor", "s.span")
        kinds = each.groupBy("span").agg(F.min(F.struct("doc_id", "row", "at")).alias("rep"), F.max("doc_id").alias("last"), F.min("anchor").alias("anchor"))
        kinds = cut(kinds.select("span", "anchor", "rep", F.col("rep.doc_id").alias("first"), "last"), "span-kinds")
        ends = cut(_ends(kinds, found), "span-ends")
        known = cut(kinds.select("span", "first", "last").join(ends, "span", "left").filter("first < last OR windows IS NOT NULL").select("span", "first", "windows"), "span-facts")
        marked = each.join(known, "span").filter("doc_id > first OR windows IS NOT NULL")
        all_of_it = F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)
        marked = marked.select("row", F.when(F.col("doc_id") > F.col("first"), all_of_it).otherwise(F.transform("windows", lambda j: F.col("start") + j)).alias("starts"))
        removed = cut(marked.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("removed")), "removed-windows")
        keep += [found, removed]
    return found.drop("spans", "hashes").join(removed, "row", "left")


def digest(documents: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    rows = repeats(documents, window, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, sha, gone = _binary(b.column("text")), b.column("removed"), b.column("kept_sha256").to_pylist(), []
            for i, t in enumerate(texts):
                n = 0
                if sha[i] is None:
                    at = starts[i].values.to_numpy(zero_copy_only=False) if starts[i].is_valid else np.empty(0, np.int64)
                    n, kept = _text_without((t or b"").split(), at, window)
                    sha[i] = hashlib.sha256(kept).hexdigest()
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "n_words", "kept_sha256", "text", "removed").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
