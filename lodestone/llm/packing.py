"""Best-fit packing by minimum bin slack.

A document's ids and an end id are cut into pieces of at most ``capacity`` tokens (only
longer ones are cut). Packing looks at the number of pieces of each length alone, at most
``capacity`` numbers whatever the input. Bin by bin, the longest piece left is placed and a
subset-sum over the lengths still available, on a bitset of reachable sums, finds the
combination that fills the rest best; that combination is then removed. As equal lengths are
interchangeable, a combination is removed as many times at once as its lengths allow.

Pieces are numbered within their length without a global order: by hash into groups of a
bounded number of rows, with offsets from a table of group sizes; so one very common
length is spread too. A piece finds its sequence and offset from its number.

Defined results: null text is empty and gives one piece, the end id; repeated rows are
packed each; null ids are carried; columns beyond ``doc_id`` and ``text`` are ignored; an
empty table gives no rows. Sequence numbers run from 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.tables import cut
from lodestone.llm.tokens import worker_tokens

CAPACITY = 2048
END = np.zeros(1, "<u4").tobytes()
#: Rows that one numbering group holds on average.
GROUP_ROWS = 200_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(tokenizer)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = b.column("text").cast(pa.large_binary())
            for i in range(len(texts)):
                ids = tokens.ids(texts[i].as_py()) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrays = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of ``counts`` (length -> how many are left) the combination with the greatest sum up to ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, take = left - take, 2 * take
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            found[length] = found.get(length, 0) + take
    return found


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, length -> pieces in each): every piece of ``counts`` once."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        use = fullest({k: v for k, v in counts.items() if v}, capacity - top)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        out.append((times, use))
        for k, n in use.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def _places(made: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and combination: the first number it serves, pieces a bin, first sequence, offset."""
    rows, used, sequence = [], {}, 0
    for times, use in made:
        at = 0
        for length, n in sorted(use.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, sequence, at))
            used[length] = used.get(length, 0) + times * n
            at += length * n
        sequence += times
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "first", "each", "sequence", "at"))}


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``number``, from 0 without gaps within each length; ``at`` tells rows apart."""
    groups = max(16, total // GROUP_ROWS)
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("at"), F.lit(groups)))
    sums = rows.groupBy("length", "_g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.select("length", "_g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "piece-groups")
    within = F.row_number().over(Window.partitionBy("length", "_g").orderBy("at")) - 1
    return rows.withColumn("_within", within).join(sums, ["length", "_g"]).withColumn("number", F.col("_before") + F.col("_within")).drop("_g", "_within", "_before")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, capacity, tokenizer).withColumn("at", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(bins(counts, capacity))
    key = places["length"] << 44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            i = np.searchsorted(key + places["first"], (length << 44) + number, "right") - 1
            past = number - places["first"][i]
            sequence = places["sequence"][i] + past // places["each"][i]
            offset = places["at"][i] + past % places["each"][i] * length
            arrays = [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ready = numbered(rows, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return ready.mapInArrow(run, _PIECE + ", sequence_id long, offset long")
