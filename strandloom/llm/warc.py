"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writing.  One gzip member a record.  Of records with equal payloads of at least ``min_bytes`` bytes, that with the
smallest id is a ``response``; the others are ``revisit`` records, which carry the HTTP headers, the payload's digest
and the response's record id, but no payload.  Each task writes a file of its own under a fresh name and reports it in a
manifest table, so files of failed or repeated attempts are never read.

Reading.  Files are dealt to tasks as byte ranges.  A task looks for the gzip magic from the start of its range,
validates a candidate by decoding it to a WARC version line, then follows the members one by one, as each tells where
the next begins.  It owns exactly the records that start inside its range, and reads beyond the end for the last one.
Bytes that decode to no record are skipped to the next valid member.

Paths are URIs that ``pyarrow.fs`` opens (file, hdfs, s3, gs); archives go to the shared folder by default.

Scale.  Groups of equal payloads are found by digest alone, with combined minima, and written, those of several pages only.  Where Spark
finds that table small enough, payloads aren't shuffled; else they are once, by digest, and as both sides of the join are plain exchanges, a group
that holds much of the table is split at run time (skew join).  A task holds one range and one record.

Cases.  Null html: empty payload.  Null url: no target header; control characters in urls are percent-encoded.  Null
page_id: kept, as null, and never the response of a group that has ids.  Repeated rows: those with the smallest id are
all responses.  Ties in the smallest id: see there.  Very long payloads: a record is
packed and unpacked whole in one task, one at a time.  Empty table: no files, no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, new_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
RANGE_BYTES = 16 << 20
BLOCK_BYTES, FEED_BYTES = 1 << 20, 8 << 10
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, digest_ok boolean, path string, offset bigint"
_LEVEL = 6


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_responses(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: null for responses."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    hashed = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = hashed.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(groups.select("sha", "first_id"), "warc-groups")
    again = F.col("first_id").isNotNull() & (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return hashed.join(first, "sha", "left").select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    """One record, compressed to one gzip member."""
    payload = html.encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid4()}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes the pages and returns the manifest: path, length, records.  ``columns``: see ``with_responses``."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out = path = None
        done: list[tuple[str, int, int]] = []
        size = n = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path, size, n = f"part-{uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                out.write(member := record(row["page_id"], row["url"], row["html"], row["refers_to"]))
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{path}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", size, n))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "length", "records"), x)) for x in done], pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())]))

    return cut(with_responses(pages, **columns).mapInArrow(run, "path string, length bigint, records bigint"), "warc-manifest")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the archives under a path, for archives made elsewhere; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


class _Window:
    """A file's bytes from an offset on, of which only those between the reader's place and the last block read are held."""

    def __init__(self, data: pa.NativeFile, start: int):
        self.data, self.held, self.base, self.at = data, b"", start, start
        data.seek(start)

    def more(self) -> bool:
        """Reads a block behind those held, and forgets what lies before the place."""
        block = self.data.read(BLOCK_BYTES)
        self.held, self.base = self.held[self.at - self.base :] + block, self.at
        return bool(block)

    def find_magic(self, end: int) -> bool:
        """Moves to the next magic that starts before ``end``."""
        while True:
            found = self.held.find(MAGIC, self.at - self.base)
            if found >= 0:
                self.at = self.base + found
                return self.at < end
            self.at = max(self.at, self.base + len(self.held) - len(MAGIC) + 1)
            if self.at >= end or not self.more():
                return False

    def member(self) -> tuple[bytes, int] | None:
        """Content of the gzip member here and the offset after it; None if it is no whole WARC record.  The place stays."""
        unpack, parts, head, fed = zlib.decompressobj(31), [], b"", self.at
        try:
            while not unpack.eof:
                if fed == self.base + len(self.held) and not self.more():
                    return None
                piece = self.held[fed - self.base : fed - self.base + FEED_BYTES]
                parts.append(unpack.decompress(piece))
                fed += len(piece)
                head = head or parts[-1]
                if not (head.startswith(VERSION) or VERSION.startswith(head)):
                    return None
        except zlib.error:
            return None
        return (content, fed - len(unpack.unused_data)) if (content := b"".join(parts)).startswith(VERSION) else None


def members(data: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the WARC members that start in [start, end)."""
    window = _Window(data, start)
    while window.find_magic(end):
        at = window.at
        if found := window.member():
            yield at, found[0]
            window.at = found[1]
        else:
            window.at = at + 1


_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "replace").strip() for k, v in _HEADER.findall(raw)}


def parse(content: bytes) -> tuple[dict, bytes | None]:
    """The fields of a record, and its payload (null: none is stored, and there is nothing to hold its digest against)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    urn = lambda x: int(x[len(URN) + 1 : -1]) if x.startswith(f"<{URN}") else None
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2]
    out = {"page_id": urn(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": urn(fields.get("warc-refers-to", ""))}
    if kind == "revisit":
        return out | {"payload_bytes": int(_headers(http).get("content-length", 0)), "payload_digest": stated, "digest_ok": None}, None
    found = digest(payload)
    return out | {"payload_bytes": len(payload), "payload_digest": found, "digest_ok": found == stated}, payload


def read_archives(files: DataFrame, *, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records (``RECORDS``) of archives, given as path and length; with_payload adds ``payload`` (binary, null for revisits)."""
    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(n))  # a task a range; the rows are few and small, so no size would ask for more tasks
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    full = RECORDS + ", payload binary" * with_payload
    schema = pa.schema([(n, kinds[k.split()[1]]) for n, k in zip(names, full.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(r["path"])
                rows, size = [], 0
                with fs.open_input_file(at) as data:
                    for offset, content in members(data, r["start"], r["end"]):
                        fields, payload = parse(content)
                        rows.append(fields | {"path": r["path"], "offset": offset} | ({"payload": payload} if with_payload else {}))
                        size += len(content) if with_payload else 256
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(run, full)
