"""WARC records in seekable Zstandard bundles, and their way back.

A bundle is a run of independent frames of about FRAME_BYTES of records each,
closed by a skippable frame that holds the seek table (compressed and plain
size of every frame), so that any reader of the format can seek.  The index maps
each record to its bundle, the offset of its frame and its place in the frame.

Equal payloads are stored once: the record with the smallest page_id is a
response, the others revisit it and carry no payload but its digest and length.

A task writes to names that hold its attempt, and only rows of finished tasks
enter the index, so a repeated or doubled attempt leaves a file that nothing
refers to but never a wrong offset.  Files go through the file system of the
folder's URI (pyarrow.fs), by default the folder all executors share.

Defined cases: a null html is an empty payload; a null page_id is written as
such, and a null url as a URN of the page; rows repeating both page_id and
payload of a response are responses too; a payload of any length is one record in
one frame; an empty table writes no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, cut, mapped, shared_dir, slices

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
#: Plain bytes of records that a task reads back on average.
TASK_BYTES = 64 << 20
DATE = "2025-01-01T00:00:00Z"
# Fixed values of the seekable format: skippable frame magic, seek table magic, table without checksums.
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if " " < c < "\x7f" or c > "\xa0" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = head + 4 + int(headers["Content-Length"])
    block = data[head + 4 : end]
    return headers, block[block.index(b"\r\n\r\n") + 4 :], end + 4


class BundleWriter:
    """Frames of records in one file, closed by their seek table."""

    def __init__(self, stream):
        self.stream, self.frames, self.pending, self.held, self.offset = stream, [], [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Where the record will be: offset of its frame, and offset in the frame."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self.flush()
        place = self.offset, self.held
        self.pending.append(data)
        self.held += len(data)
        return place

    def flush(self) -> None:
        if self.pending:
            frame = self.compressor.compress(b"".join(self.pending))
            self.stream.write(frame)
            self.frames.append((len(frame), self.held))
            self.offset += len(frame)
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    file.seek(size - 9 - 8 * n)
    frames, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        frames.append((at, compressed, plain))
        at += compressed
    return frames


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bundles(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write every page; the index (page_id, record_id, file, frame, at, length)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only digests that occur again matter, so payloads stay where they are while those are few.
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = cut(repeated.select("digest", "first", F.lit(True).alias("again")))
    known = rows.join(broadcast_if_small(repeated), "digest", "left")
    known = known.withColumn("revisit", (F.octet_length("payload") >= least) & F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        attempt, writer, name = TaskContext.get().taskAttemptId(), None, ""
        n_files = 0
        for batch in slices(batches, "payload"):
            out: list[tuple] = []
            for row in batch.to_pylist():
                if writer is None or writer.offset >= BUNDLE_BYTES:
                    if writer:
                        writer.close()
                    name = f"bundle-{attempt:08d}-{n_files:04d}.warc.zst"
                    n_files += 1
                    writer = BundleWriter(system.open_output_stream(f"{root}/{name}", compression=None))
                data = record(row["page_id"], row["url"], row["payload"], row["first"], row["revisit"])
                out.append((row["page_id"], record_id(row["page_id"]), name, *writer.add(data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(index_types)], index_names)
        if writer:
            writer.close()

    index_names = ["page_id", "record_id", "file", "frame", "at", "length"]
    index_types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = "page_id long, record_id string, file string, frame long, at long, length long"
    return mapped(known.select("page_id", "url", "payload", "first", "revisit"), run, schema)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index point to, each frame opened once by seeking to it."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        system, root = open_folder(folder)
        name, file, frames, frame, data = None, None, {}, None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file:
                        file.close()
                    name, frame = row["file"], None
                    file = system.open_input_file(f"{root}/{name}")
                    frames = {at: (compressed, plain) for at, compressed, plain in seek_table(file)}
                if row["frame"] != frame:
                    frame = row["frame"]
                    compressed, plain = frames[frame]
                    file.seek(frame)
                    data = zstandard.ZstdDecompressor().decompress(file.read(compressed), max_output_size=plain)
                headers, payload, _ = parse_record(data, row["at"])
                kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and payload_digest(payload) != stated:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                number = lambda h: int(headers[h]) if headers.get(h) else None  # noqa: B023, E731
                length = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                yield number("X-Page-Id"), length, stated, kind, number("X-Refers-To-Page-Id"), headers["WARC-Target-URI"], payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for row in rows_of(batches):
            out.append(row)
            held += len(row[-1])
            if held > FRAME_BYTES * 8 or len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    # A frame's records stay together; the frames of one bundle may go to several tasks.  Rows of the index are
    # small and what they point to is not, so the number of tasks follows the bytes behind them.
    behind = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, behind // TASK_BYTES)
    dealt = index.select("file", "frame", "at").repartition(tasks, "file", "frame").sortWithinPartitions("file", "frame", "at")
    return mapped(dealt, run, schema)


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages, read them back, and describe what was read."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = cut(write_bundles(pages, folder, least))
    return read_records(index, folder).drop("url", "payload")


#: What reading back must give, over whole pages: SHA-1 in base32, and the first page of each payload.
ROUND_TRIP_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as d, min(page_id) over (partition by h) as first from p),
b as (
  select *, list_transform([1, 11, 21, 31], lambda k: ('0x' || substr(d, k, 10))::ubigint) as v from d)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::int + 1, 1)), '') as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from b
"""
