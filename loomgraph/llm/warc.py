"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the format's skippable seek table, and an
index maps record identifiers to (bundle, frame, offset inside the frame). Each writing task names its
bundles anew and returns them as rows, so a bundle left behind by a lost or repeated task is in no index and
is never read. Bundles go to the shared folder through a file-system URI.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, bounded_batches, durable, shared_dir, table

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.encode("unicode_escape").decode("ascii"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview, at: int) -> tuple[dict, int]:
    """The record that starts at an offset of a frame, and where the next one starts."""
    raw = bytes(data[at : at + (64 << 10)])
    end = raw.find(b"\r\n\r\n")
    while end < 0 and len(raw) < len(data) - at:
        raw = bytes(data[at : at + 4 * len(raw)])
        end = raw.find(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = at + end + 4, int(head["Content-Length"])
    block = bytes(data[start : start + size])
    cut = block.index(b"\r\n\r\n")
    length = int(next(x for x in block[:cut].decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    strip = lambda x: x and x.strip("<>")
    uri = head.get("WARC-Target-URI")
    out = {
        "record_id": strip(head["WARC-Record-ID"]), "record_type": head["WARC-Type"],
        "uri": uri and uri.encode("ascii").decode("unicode_escape"), "refers_to": strip(head.get("WARC-Refers-To")),
        "payload_bytes": length, "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = block[cut + 4 :]
        if len(out["payload"]) != length or hashlib.sha256(out["payload"]).hexdigest() != out["payload_digest"]:
            raise ValueError(f"{out['record_id']}: the payload is not what was written")
    return out, start + size + 4


class Bundle:
    """Writes one bundle: frames as they fill, then the seek table."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.fs, path = fs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.index: list[tuple[str, str, int, int, int]] = []

    def add(self, record_id: str, data: bytes) -> None:
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append((record_id, self.uri, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> list[tuple[str, str, int, int, int]]:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.index


class BundleReader:
    """Opens a bundle by its footer; frames are read one at a time."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.at = [0]
        for packed, _ in sizes:
            self.at.append(self.at[-1] + packed)
        self.sizes = sizes

    def frame(self, k: int) -> memoryview:
        packed = self.file.read_at(self.at[k + 1] - self.at[k], self.at[k])
        return memoryview(zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.sizes[k][1]))

    def fetch(self, frame: int, offset: int) -> dict:
        return parse_record(self.frame(frame), offset)[0]

    def __iter__(self) -> Iterator[dict]:
        for k in range(len(self.sizes)):
            data, at = self.frame(k), 0
            while at < len(data):
                out, at = parse_record(data, at)
                yield out


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Writes (record_id, record_type, uri, refers_to, payload, digest) rows; returns the index, durably."""
    arrow = _arrow_schema(records.sparkSession, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: Bundle) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*b.close(), strict=True), arrow, strict=True)], schema=arrow)

        bundle = None
        for batch in batches:
            for r in batch.to_pylist():
                bundle = bundle or Bundle(folder)
                bundle.add(r["record_id"], record(r["record_id"], r["record_type"], r["uri"], r["refers_to"], r["payload"] or b"", r["digest"]))
                if bundle.written >= BUNDLE_BYTES:
                    yield out(bundle)
                    bundle = None
        if bundle:
            yield out(bundle)

    return durable(records.select("record_id", "record_type", "uri", "refers_to", "payload", "digest").mapInArrow(run, INDEX))


def read_bundles(index: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the index's bundles, a bundle at a time; each response is checked against its digest."""
    arrow = _arrow_schema(index.sparkSession, RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for x in BundleReader(uri):
                    size += len(x["payload"] or b"")
                    held.append(x if payload else x | {"payload": None})
                    if len(held) >= 1000 or payload and size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    # Few short rows, and each is much to read: as many tasks as there are bundles, about.
    bundles = index.select("bundle").distinct()
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bundles.repartition(tasks, "bundle").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to bundles and returns the index (see INDEX).

    - A null html is an empty payload. Of equal payloads of 100 bytes or more the smallest id is a response and the
      others revisit it; smaller payloads are all responses.
    - A null id comes after all others; rows that repeat the smallest id of their group are all responses.
    - Payloads are equal when their SHA-256 and length are. An empty table gives an empty index. Very long payloads have
      a frame of their own. Other columns are not read, whatever their names.
    - A record's identifier is made of the page's id, so rows that repeat an id, or have none, share one: the index has a
      row for each of them, with the place of its own record.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    base = pages.select(F.col(id).alias("_id"), F.col(url).cast("string").alias("uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("_d", F.unhex(F.sha2("payload", 256)))
    first = base.where(F.length("payload") >= LEAST_REVISIT).groupBy("_d").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = base.join(first, "_d", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return write_bundles(
        rows.select(
            name("_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri",
            F.when(revisit, name("_first")).alias("refers_to"), "payload", F.lower(F.hex("_d")).alias("digest"),
        ),
        folder,
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    back = read_bundles(archive_pages(pages), payload=False)
    number = lambda c: F.when(F.col(c) != "urn:page:null", F.substr(F.col(c), F.lit(len("urn:page:") + 1))).cast(kind)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY h) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to
FROM p
"""
