"""WARC archives of Zstandard frames: written by the executors, read back record by record.

An archive starts with a skippable frame that holds a dictionary (as it is, or compressed as
a frame of its own); then each record is one frame. The dictionary is trained on the first
payloads of the archive, within a bounded number of bytes. A record is a version line,
headers, an empty line and exactly ``Content-Length`` bytes, closed by two line ends; its block is an HTTP
response. Of pages with equal payloads of at least ``least`` bytes that with the largest
page_id is written as a response, and the others revisit it: their block ends after the HTTP
headers, whose Content-Length still tells the payload's length.

Archives lie in the folder that all executors share, under names that hold the task's
attempt; only names that finished tasks return are read, so a task that is run again does
no harm. Writing and reading hold one record (and, before the dictionary is there, its
samples) in memory. Paths go to :mod:`pyarrow.fs`, which knows local folders and the usual stores.

Defined results: null html is an empty payload, always a response; a null url has no target
header; rows that repeat the largest page_id are all responses; a null page_id counts as the
smallest, and is the response of a group only if all ids are null; extra columns are
ignored; an empty table gives no rows. Broken archives raise :class:`WarcError`.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.tables import cut, fresh_path, owned

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
LEAST = 1000
DICT_BYTES, SAMPLE_BYTES, SAMPLE_ITEMS = 32 << 10, 2 << 20, 400
DATE = "2024-01-01T00:00:00Z"
_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive is not as the format has it."""


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise WarcError(f"not the id of a page: {uri}")
    return None if uri[10:-1] == "none" else int(uri[10:-1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record in full."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out: BinaryIO, records: Iterable[bytes], level: int = 3) -> int:
    """Write the records after a dictionary trained on the first of them; returns their number."""
    records, first, size = iter(records), [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES or len(first) >= SAMPLE_ITEMS:
            break
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, [r[:65536] for r in first]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: its text itself serves
        trained = b"".join(first)[:DICT_BYTES] or b"WARC/1.1\r\n"
    packed = zstandard.ZstdCompressor(level=19).compress(trained)
    out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    n = 0
    for part in (first, records):
        for r in part:
            out.write(compressor.compress(r))
            n += 1
    return n


class _Frames:
    """One frame's bytes at a time."""

    def __init__(self, source: BinaryIO, dictionary: zstandard.ZstdCompressionDict | None, rest: bytes):
        self.source, self.decoder = source, zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        self.rest, self.at = rest, 0

    def __iter__(self) -> Iterator[bytes]:
        while True:
            if not self.rest:
                self.rest = self.source.read(1 << 16)
            if not self.rest:
                return
            frame, parts = self.decoder.decompressobj(), []
            while not frame.eof:
                if not self.rest:
                    self.rest = self.source.read(1 << 16)
                    if not self.rest:
                        raise WarcError("the archive ends within a frame")
                try:
                    parts.append(frame.decompress(self.rest))
                except zstandard.ZstdError as e:
                    raise WarcError(f"not a frame: {e}") from e
                self.rest = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def frames(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, each from its own frame; the dictionary comes from the leading skippable frame."""
    head = source.read(8)
    if not head:
        return
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", head[4:])[0]
        data = source.read(size)
        if len(data) < size:
            raise WarcError("the dictionary is cut off")
        if data[:4] == FRAME:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 26)
        kind = zstandard.DICT_TYPE_AUTO
        dictionary, rest = zstandard.ZstdCompressionDict(data, dict_type=kind), b""
    elif len(head) < 4 or head[:4] != FRAME:
        raise WarcError("neither a dictionary nor a frame at the start")
    yield from _Frames(source, dictionary, rest)


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    """(first line, headers by lower-case name, what follows the empty line)."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"{what}: the headers do not end")
    try:
        first, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"{what}: the headers are not UTF-8") from e
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"{what}: not a header: {line[:80]}")
        out[name.strip().lower()] = value.strip()
    return first, out, rest


def _length(headers: dict[str, str], what: str) -> int:
    found = headers.get("content-length", "")
    if not (found.isascii() and found.isdigit()):
        raise WarcError(f"{what}: no valid Content-Length")
    return int(found)


def parse(data: bytes) -> dict:
    """A record's facts, after its version, headers, lengths and digest have been checked."""
    version, head, rest = _headers(data, "record")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"unknown version {version[:40]}")
    missing = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest"} - head.keys()
    if missing:
        raise WarcError(f"headers are missing: {sorted(missing)}")
    if len(rest) != _length(head, "record") + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the record is not as long as it says")
    _, http, payload = _headers(rest[:-4], "block")
    size, kind = _length(http, "block"), head["warc-type"]
    label, _, digest = head["warc-payload-digest"].partition(":")
    if label != "sha1" or len(digest) != 40:
        raise WarcError("not a SHA-1 digest")
    refers = None
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload is not what its length and digest say")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in head or "warc-profile" not in head:
            raise WarcError("a revisit has no payload, but a profile and a target")
        refers = _page(head["warc-refers-to"])
    else:
        raise WarcError(f"unknown record type {kind[:40]}")
    return {"page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to, revisit for each row of ``pages``.

    Only digests that occur twice or more are joined back, with one id each.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("_size"))
    groups = rows.filter(F.col("_size") >= least).groupBy("digest", "_size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1 AND top IS NOT NULL").select("digest", "_size", "top"), "payload-groups")
    out = rows.join(groups, ["digest", "_size"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return out.select("page_id", "url", "html", "digest", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the archives, one a task, and return their (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"

        def records() -> Iterator[bytes]:
            for b in batches:
                for i in range(b.num_rows):
                    page, url, html, digest, refers, revisit = (b.column(c)[i].as_py() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))
                    yield record(page, url, html, digest, refers, revisit)

        each = records()
        first = next(each, None)
        if first is None:
            return
        system.create_dir(base, recursive=True)

        def again() -> Iterator[bytes]:
            yield first
            yield from each

        with system.open_output_stream(name) as out:
            n = write_archive(out, again())
        yield pa.RecordBatch.from_arrays([pa.array([name.removeprefix(base + "/")]), pa.array([n], pa.int64())], ["path", "records"])

    return with_roles(pages, least).mapInArrow(run, "path string, records long")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives (path: names within ``folder``), checked; one archive at a time in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for b in batches:
            for path, want in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with system.open_input_stream(f"{base}/{path}") as source:
                    for data in frames(source):
                        rows.append({k: v for k, v in parse(data).items() if k != "payload"})
                        n += 1
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
                if n != want:
                    raise WarcError(f"{path} has {n} records; {want} were written")
                if rows:
                    yield batch(rows)

    return archives.mapInArrow(run, _RESULT)


def dangling(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits for which no response of that id and digest is there."""
    asked = records.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return asked.join(held, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all of ``pages`` into the shared folder, then read the archives back, one a task.

    The archives, and what attempts that failed left behind beside them, are deleted once they are read.
    """
    keep: list[DataFrame] = []
    with owned(keep):
        folder = fresh_path(pages.sparkSession, "warc")
        archives = cut(write(pages, folder, least), "warc-list")
        each = Window.orderBy("path")  # of the list of names alone
        numbered = archives.withColumn("_at", F.row_number().over(each))
        records = cut(read(numbered.repartitionByRange(max(1, archives.count()), "_at").select("path", "records"), folder), "warc-records")
        keep.append(records)
        if not dangling(records).isEmpty():
            raise WarcError("a revisit refers to a response that no archive holds")
    return records


def read_bytes(data: bytes) -> list[dict]:
    """The records of one archive in memory."""
    return [parse(x) for x in frames(io.BytesIO(data))]
