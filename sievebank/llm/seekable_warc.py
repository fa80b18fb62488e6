"""WARC archives in seekable Zstandard bundles.

A bundle is one archive: records are grouped into independent Zstandard frames, and a
skippable frame with the table of frame sizes ends it (the published seekable format), so a
reader finds any frame from the last bytes alone.  An index maps each record's id to its
bundle, its frame and its place inside that frame.

A bundle is a row of a Parquet table in the shared folder (``archive`` holds the file's
bytes), so executors write and read it through Spark alone, in whatever store that folder
is.  ``export`` writes the bytes as plain ``.warc.zst`` files.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes one, that with the largest
id, is a response, and the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import persist, text_or_empty

REVISIT_BYTES = 1000
#: Plain bytes after which a frame, and archived bytes after which a bundle, is closed.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BUNDLES = T.StructType(
    [
        T.StructField("bundle", T.StringType()),
        T.StructField("archive", T.BinaryType()),
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("record_id", T.StringType()),
                        T.StructField("frame", T.IntegerType()),
                        T.StructField("offset", T.LongType()),
                        T.StructField("length", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("bundle", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)


class Bundle:
    """An archive that is being written."""

    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open = bytearray()
        self.stored = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.entries.append({"record_id": record_id, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.stored += len(frame)
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer


class Reader:
    """An archive's frames, found from its seek table."""

    def __init__(self, archive: bytes):
        self.archive = archive
        count, flags, magic = struct.unpack("<IBI", archive[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end")
        entry = 12 if flags & 0x80 else 8
        begin, self.at = len(archive) - 9 - entry * count, [0]
        self.plain = []
        for k in range(count):
            stored, plain = struct.unpack_from("<II", archive, begin + entry * k)
            self.at.append(self.at[-1] + stored)
            self.plain.append(plain)
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        """One frame's plain bytes; no other is read."""
        return self.unpacker.decompress(self.archive[self.at[k] : self.at[k + 1]], max_output_size=self.plain[k])


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes
    digest: str
    refers_to: int | None


def one_line(x: str | None) -> str:
    """A header's value: control characters would end it, so they are written as %XX."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in x or "")


def record_of(page: Page) -> tuple[str, bytes]:
    """The id and the bytes of a page's record."""
    record_id = f"<urn:page:{'' if page.page_id is None else page.page_id}>"
    revisit = page.refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + page.payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{page.digest}",
        f"X-Payload-Length: {len(page.payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page.url is not None:
        head.append(f"WARC-Target-URI: {one_line(page.url)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{page.refers_to}>"]
    return record_id, "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, rest[:n]


def number(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def write_bundles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write a record for each row into bundles, and return the table of bundles.

    A null payload is empty, a null url is left out, a null id is an empty name.  Rows that
    share the largest id of a group of equal payloads are all responses.
    """
    payload = F.encode(text_or_empty(payload_column), "UTF-8")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    long = F.octet_length("payload") >= REVISIT_BYTES
    same = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # written, so that both sides of the join are dealt anew and a hot payload can be split
    same = persist(same.filter("n > 1").select("digest", "first"), "payloads")
    known = rows.join(same.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & long, "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"bundle": f"part-{part:06d}-{k:05d}.warc.zst", "archive": bundle.finish(), "entries": bundle.entries}], ARROW_BUNDLES
            )

        for batch in batches:
            for page in map(Page._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                bundle.add(*record_of(page))
                if bundle.stored >= BUNDLE_BYTES:
                    yield done()
                    k, bundle = k + 1, Bundle()
        if bundle.entries:
            yield done()

    return persist(known.mapInArrow(run, BUNDLES), "warc")


ARROW_BUNDLES = pa.schema(
    [
        ("bundle", pa.string()),
        ("archive", pa.binary()),
        ("entries", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)


def index_of(bundles: DataFrame) -> DataFrame:
    """A row for each record: where it is."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("bundle", "e.*")


def read_records(bundles: DataFrame) -> DataFrame:
    """Read every record by way of the index and the seek table, and check its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, archive, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, have, frame = Reader(archive), -1, b""
                for e in entries:
                    if e["frame"] != have:
                        have, frame = e["frame"], reader.frame(e["frame"])
                    headers, block = parsed(frame[e["offset"] : e["offset"] + e["length"]])
                    if headers["WARC-Record-ID"] != e["record_id"]:
                        raise ValueError(f"{e['record_id']} is not where the index says")
                    kind, digest, refers = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    size = int(headers["X-Payload-Length"])
                    if kind == "revisit":
                        refers = number(headers["WARC-Refers-To"])
                    else:
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{e['record_id']}: the payload differs from its digest")
                    out.append((number(e["record_id"]), size, digest, kind, refers, headers.get("WARC-Target-URI"), e["record_id"], name, have, e["offset"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW_RECORDS, strict=True)], RECORDS.names)

    return bundles.mapInArrow(run, RECORDS)


ARROW_RECORDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64())


def export(bundles: DataFrame, folder: str) -> None:
    """Write the bundles as files into a folder that every executor has mounted."""

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            at = os.path.join(folder, row["bundle"])
            with open(at + ".tmp", "wb") as f:
                f.write(row["archive"])
            os.replace(at + ".tmp", at)

    bundles.select("bundle", "archive").foreachPartition(save)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back."""
    return read_records(write_bundles(pages))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM m
"""
