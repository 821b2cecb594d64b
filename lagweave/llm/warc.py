"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames, frames into bundles.  A bundle ends in a seek
table (a skippable frame with the compressed and plain size of every frame), so one frame can
be read without the others, and an index maps each record to its frame and its offset there.
Bundles are rows of a table in the shared folder, so any store that Spark can write holds them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "array<struct<record_id:string,frame:int,offset:int,length:int>>"
ARROW_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    tail = record.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record in plain bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not at the start of a record")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        at = end + 4 + int(head["content-length"])
        yield head, data[end + 4 : at]
        at += 4


def read_back(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record; a response's payload is checked against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    claimed = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != claimed):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    refers = head.get("warc-refers-to")
    return page_of(head["warc-record-id"]), size, claimed, head["warc-type"], page_of(refers) if refers else None


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, plain) size of every frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_offsets(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the seek table at the end."""
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC or descriptor:
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - k))
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    at, packed, plain = frame_offsets(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=max(1, plain))


def read_record(data: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; only its frame is decompressed."""
    return next(parse_records(read_frame(data, frame)[offset : offset + length]))


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open: list[bytes] = []
        self.held = self.packed = 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.held, "length": len(record)})
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.coder.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.packed += len(frame)
            self.open, self.held = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self.close_frame()
        return b"".join(self.frames) + seek_table(self.sizes), self.index


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with ``refers_to``: of equal payloads of at least ``min_bytes`` bytes the smallest page_id, null for that page itself."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    joined = rows.join(materialize(first, "equal-payloads"), "sha", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str | None = None, min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """Write a record for every row of pages and return the table (bundle_id, data, index).

    Null html is an empty payload, a null url has no target header, a null page_id is archived as
    ``<urn:page:none>``; rows that repeat a page are archived each, none a revisit of itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(frame_bytes, level)

        def bundle() -> pa.RecordBatch:
            data, index = writer.finish()
            columns = [pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([index], ARROW_INDEX)]
            return pa.RecordBatch.from_arrays(columns, ["bundle_id", "data", "index"])

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(record_id(page), build_record(page, url, payload, refers))
                if writer.packed >= bundle_bytes:
                    yield bundle()
                    writer = BundleWriter(frame_bytes, level)
        if writer.index:
            yield bundle()

    return materialize(plan_records(pages, min_bytes).mapInArrow(run, f"bundle_id string, data binary, index {INDEX}"), "warc-bundles", path)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for data in batch["data"]:
                data = data.as_py()
                for k in range(len(frame_offsets(data))):
                    rows = [read_back(*r) for r in parse_records(read_frame(data, k))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return bundles.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle_id, frame, offset, length): where each record is."""
    return bundles.select("bundle_id", F.explode("index").alias("x")).select("x.record_id", "bundle_id", "x.frame", "x.offset", "x.length")
