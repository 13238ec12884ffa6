"""WARC archives in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each of whole records, and at its end a skippable frame with the seek
table (compressed and uncompressed size of every frame, in the public seekable format), so any Zstandard tool can unpack
it. The index maps a record identifier to bundle, frame and place inside the unpacked frame: one record costs one frame.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.tables import broadcast_if_small, cut
from sluice.session import scratch_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
REVISIT_BYTES = 100
INDEX = "record_id string, bundle string, frame int, start long, length long"
RECORD = ("record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
          "refers_to string, payload binary")

# Fixed values of the formats: WARC 1.1, and the seek table of seekable Zstandard.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; with `refers_to` a revisit, which keeps the HTTP headers and leaves the payload out.

    The tables have no time of capture, so the date is the epoch, and records come out the same in every run.
    """
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{record_id}>"),
               ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if uri is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at `start` as a row of RECORD, and where the next one begins."""
    if data[start:start + len(VERSION)] != VERSION:
        raise ValueError(f"no WARC record at {start}")
    head_end = data.index(b"\r\n\r\n", start)
    head = dict(x.split(": ", 1) for x in data[start:head_end].decode().split("\r\n")[1:])
    block_start = head_end + 4
    block_end = block_start + int(head["Content-Length"])
    if data[block_end:block_end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {start} is cut off")
    http_end = data.index(b"\r\n\r\n", block_start) + 4
    http = dict(x.split(": ", 1) for x in data[block_start:http_end - 4].decode().split("\r\n")[1:])
    inner = re.compile("<urn:page:(.*)>", re.S).fullmatch
    revisit = head["WARC-Type"] == "revisit"
    return {"record_id": inner(head["WARC-Record-ID"])[1], "record_type": head["WARC-Type"],
            "target_uri": head.get("WARC-Target-URI"), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload_bytes": int(http["Content-Length"]),
            "refers_to": inner(head["WARC-Refers-To"])[1] if revisit else None,
            "payload": None if revisit else data[http_end:block_end]}, block_end + 4


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class BundleWriter:
    """Writes records to bundles in one folder; holds one frame of records at a time."""

    def __init__(self, folder: str, name: str, frame_bytes: int, bundle_bytes: int) -> None:
        self.folder, self.name, self.frame_bytes, self.bundle_bytes = folder, name, frame_bytes, bundle_bytes
        self.bundles, self.stream = 0, None
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frame, self.length = [], 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """Append a record; its bundle, frame, start within the frame, and length."""
        if self.stream is None:
            self.path = posixpath.join(self.folder, f"{self.name}-{self.bundles:05d}.warc.zst")
            files, inner = _open(self.path)
            self.stream = files.open_output_stream(inner, compression=None)  # else guessed from the name
            self.sizes, self.written = [], 0
        place = (self.path, len(self.sizes), self.length, len(data))
        self.frame.append(data)
        self.length += len(data)
        if self.length >= self.frame_bytes:
            self.end_frame()
            if self.written >= self.bundle_bytes:
                self.close()
        return place

    def end_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.stream.write(packed)
            self.sizes.append((len(packed), self.length))
            self.written += len(packed)
            self.frame, self.length = [], 0

    def close(self) -> None:
        if self.stream is not None:
            self.end_frame()
            table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
            self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
            self.stream.close()
            self.stream, self.bundles = None, self.bundles + 1


class BundleReader:
    """Unpacks single frames of a bundle, found by its seek table."""

    def __init__(self, path: str) -> None:
        files, inner = _open(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no plain seek table")
        entries = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.places, at = [], 0
        for packed, plain in struct.iter_unpack("<II", entries):
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.places[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def write(pages: DataFrame, folder: str, record_id: str = "page_id", uri: str = "url", payload: str = "html",
          frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each row to bundles in `folder` (which all executors share); the index, one row per record.

    Of rows with equal payloads of at least REVISIT_BYTES, those with the smallest identifier are responses (repeated
    rows with that identifier all are) and the others revisit it; smaller payloads are all responses. A null payload is
    empty. A null identifier is written as `null`; such a row is never revisited and, beside one that has an identifier,
    a revisit. An empty table gives no bundle and an empty index.

    Payloads are matched by SHA-256, on one narrow row for each; only digests that occur twice are joined back. A task
    names its files after itself and its attempt, and the index has only what succeeded: a task that runs again leaves
    files that nothing points at.
    """
    files, inner = _open(folder)
    files.create_dir(inner, recursive=True)
    kept = pages.select(F.col(record_id).alias("id"), F.col(uri).cast("string").alias("uri"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    marked = kept.withColumn("digest", F.sha2("payload", 256))
    again = (marked.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    rows = marked.join(broadcast_if_small(cut(again, "payloads")), "digest", "left").select(
        F.col("id").cast("string").alias("id"), "uri", "payload", "digest",
        F.when((F.octet_length("payload") >= REVISIT_BYTES) & ~F.col("id").eqNullSafe(F.col("first")),
               F.col("first").cast("string")).alias("refers_to"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, f"bundle-{uuid.uuid4().hex}", frame_bytes, bundle_bytes)
        for batch in source:
            placed = []
            for number in range(batch.num_rows):
                key, target, data, digest, refers = (c[number].as_py() for c in batch.columns)
                key = "null" if key is None else key
                placed.append((key, *writer.add(record(key, target, data, digest, refers))))
            if placed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*placed), types)], ["record_id", "bundle", "frame", "start", "length"])
        writer.close()

    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return cut(rows.mapInArrow(batches, INDEX), "warc-index")


_RECORD_ARROW = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                 ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
                 ("payload", pa.binary())]


def _records(wanted: DataFrame) -> DataFrame:
    """Rows (bundle, frame, start) -> their records; start null: every record of the frame."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = reader = number = data = None
        for batch in source:
            for bundle, frame, start in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != path:
                    path, reader, number = bundle, BundleReader(bundle), None
                if frame != number:
                    number, data = frame, reader.frame(frame)
                rows, at = [], start or 0
                while at < len(data):
                    row, at = parse(data, at)
                    if row["payload"] is not None and hashlib.sha256(row["payload"]).hexdigest() != row["payload_digest"]:
                        raise ValueError(f"payload of {row['record_id']} does not match its digest")
                    rows.append(row)
                    if start is not None:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _RECORD_ARROW],
                                                 [n for n, _ in _RECORD_ARROW])

    dealt = wanted.repartition("bundle", F.floor(F.col("frame") / 64)).sortWithinPartitions("bundle", "frame")
    return dealt.select("bundle", "frame", "start").mapInArrow(batches, RECORD)


def read(index: DataFrame) -> DataFrame:
    """All records of the bundles of an index, frame by frame; payloads are checked against their digests.

    A revisit has the digest, length and target of its payload, and a null payload.
    """
    return _records(index.select("bundle", "frame").distinct().withColumn("start", F.lit(None).cast("long")))


def fetch(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Single records: `record_ids` has one column of identifiers; unpacks only the frames that hold them."""
    wanted = record_ids.toDF("record_id").select(F.col("record_id").cast("string")).distinct()
    return _records(index.join(broadcast_if_small(wanted), "record_id").select("bundle", "frame", "start"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles, read the bundles back, and give what the records say."""
    index = write(pages, scratch_path(pages.sparkSession, "warc"))
    kind = pages.schema["page_id"].dataType
    restored = F.when(F.col("record_id") != "null", F.col("record_id")).cast(kind)
    return read(index).select(restored.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                              F.col("refers_to").cast(kind).alias("refers_to"))


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
