"""WARC archives as seekable Zstandard bundles (operator 6).

A bundle is a file of independent Zstandard frames, each holding whole WARC/1.1 records, and a
seek table in a skippable frame at its end (the seekable format's layout).  The index maps a record
identifier to its bundle, its frame and its offset in the frame, so one record costs one frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import llm_query, stored
from flowlens.session import scratch_path

#: Fixed numbers of the seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
FRAMES = "bundle string, frame int, at bigint, stored bigint"
RECORDS = "record_id string, uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder's address, and the path on it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record_bytes(record_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record.  A revisit keeps the HTTP head, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id or ''}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple]:
    """The records of a frame as rows of ``RECORDS``; a payload that doesn't have its digest is an error."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in frame[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = frame[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        named = [head[k][len("<urn:page:") : -1] or None if k in head else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
        yield named[0], head.get("WARC-Target-URI"), head["WARC-Type"], named[1], length, digest, payload if head["WARC-Type"] == "response" else None


class BundleWriter:
    """Writes records to one bundle; ``index`` gets (record id, frame, offset, length)."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.buffer, self.sizes, self.index, self.written = io.BytesIO(), [], [], 0

    def add(self, record_id: str | None, record: bytes) -> None:
        if self.buffer.tell() and self.buffer.tell() + len(record) > self.frame_bytes:
            self.end_frame()
        self.index.append((record_id, len(self.sizes), self.buffer.tell(), len(record)))
        self.buffer.write(record)

    def end_frame(self) -> None:
        raw = self.buffer.getvalue()
        if raw:
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.sizes.append((len(packed), len(raw)))
            self.written += len(packed)
            self.buffer = io.BytesIO()

    def end(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + FOOTER.pack(len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(file, size: int) -> list[tuple[int, int]]:
    """(place, stored bytes) of every frame, read from the end of a bundle."""
    file.seek(size - FOOTER.size)
    n, _, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    file.seek(size - FOOTER.size - 8 * n)
    sizes = [s for s, _ in struct.iter_unpack("<II", file.read(8 * n))]
    places = [0]
    for s in sizes:
        places.append(places[-1] + s)
    return list(zip(places, sizes, strict=False))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """``pages`` with _digest and _refers: the smallest id that has an equal payload of at least ``least`` bytes, null for
    that record itself and for smaller payloads.  Equal payloads have equal SHA-256 and length.

    Only ids and digests are grouped; a payload moves at most once, by its page's id."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    keyed = pages.withColumns({"_digest": F.sha2(body, 256), "_bytes": F.octet_length(body)})
    keys = stored(keyed.select(F.col(id_col).alias("_id"), "_digest", "_bytes").where(F.col("_bytes") >= least), "page-keys")
    first = keys.groupBy("_digest", "_bytes").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = stored(first.select(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_first"), "page-firsts")
    again = keys.join(first, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")) & (F.col("_id") != F.col("_first")))
    again = stored(again.select("_id", F.col("_digest").alias("_d"), F.col("_first").cast("string").alias("_refers")).distinct(), "page-revisits")
    return keyed.join(again, (keyed[id_col] == again["_id"]) & (F.col("_digest") == F.col("_d")), "left").drop("_id", "_d", "_bytes")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", payload: str = "html", uri: str = "url", date: str = "1970-01-01T00:00:00Z",
                  frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3, least: int = MIN_REVISIT) -> DataFrame:
    """Write a record for each row of ``pages`` to bundles in ``folder``, a shared folder; returns the stored index.

    Null payloads are empty; a null id has no identifier in the archive, and a null uri no target.
    Each task sorts its rows by id and writes its own bundles under a temporary name, then renames
    them: a repeated or speculative attempt writes the same bytes to the same name.  Records of any
    length are written whole, the longer ones in a frame of their own.  The tables hold no fetch time,
    so ``date`` stands in every record.
    """
    ready = with_revisits(pages, id_col, payload, least).select(
        F.col(id_col).cast("string").alias("record_id"), F.col(uri).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"),
        "_digest", "_refers", F.col(id_col).alias("_order"))
    ready = ready.sortWithinPartitions("_order", "_digest").drop("_order")
    schema = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part, n, bundle = TaskContext.get().partitionId(), 0, None

        def close():
            bundle.end()
            bundle.out.close()
            name = f"part-{part:06d}-{n:04d}.warc.zst"
            fs.move(bundle.path, f"{base}/{name}")
            return _batch([(r, name, f, o, size) for r, f, o, size in bundle.index], schema)

        for batch in batches:
            for k in range(batch.num_rows):
                record_id, target, body, digest, refers = (batch.column(c)[k].as_py() for c in range(5))
                if bundle is None:
                    path = f"{base}/_{uuid.uuid4().hex}"
                    bundle = BundleWriter(fs.open_output_stream(path), frame_bytes, level)
                    bundle.path = path
                bundle.add(record_id, record_bytes(record_id, target, body, digest, refers, date))
                if bundle.written >= bundle_bytes:
                    yield close()
                    n, bundle = n + 1, None
        if bundle is not None:
            yield close()

    return stored(ready.mapInArrow(write, INDEX), "warc-index")


def bundle_frames(index: DataFrame, folder: str) -> DataFrame:
    """One row per frame of the bundles in ``index``, from their seek tables."""
    schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("stored", pa.int64())])

    def footers(batches):
        fs, base = file_system(folder)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                size = fs.get_file_info(f"{base}/{name}").size
                with fs.open_input_file(f"{base}/{name}") as f:
                    rows += [(name, k, at, n) for k, (at, n) in enumerate(seek_table(f, size))]
            yield _batch(rows, schema)

    return index.select("bundle").distinct().mapInArrow(footers, FRAMES)


def _read_frame(fs, base: str, name: str, at: int, n: int) -> bytes:
    with fs.open_input_file(f"{base}/{name}") as f:
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(n))


def _record_schema() -> pa.Schema:
    return pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_bundles(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the bundles, frame by frame; payloads are checked, and returned only on request."""
    schema = _record_schema()

    def read(batches):
        fs, base = file_system(folder)
        for batch in batches:
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                rows = list(parse_records(_read_frame(fs, base, name, at, n)))
                yield _batch(rows if payloads else [(*r[:-1], None) for r in rows], schema)

    frames = stored(bundle_frames(index, folder), "warc-frames")
    return frames.repartition("bundle", "frame").mapInArrow(read, RECORDS)


def find_records(index: DataFrame, folder: str, ids: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The records whose identifier is in ``ids``, each read from its own frame at its offset.  An identifier that
    several records have gives them all; one that none has gives no row."""
    schema = _record_schema()

    def read(batches):
        fs, base = file_system(folder)
        for batch in batches:
            for name, at, n, offset, length in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                yield _batch(list(parse_records(_read_frame(fs, base, name, at, n)[offset : offset + length])), schema)

    wanted = index.join(ids.select(F.col(id_col).cast("string").alias("record_id")).distinct(), "record_id")
    frames = bundle_frames(wanted, folder)
    return wanted.join(frames, ["bundle", "frame"]).select("bundle", "at", "stored", "offset", "length").mapInArrow(read, RECORDS)


OP6_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


@llm_query("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    records = read_bundles(write_bundles(pages, folder), folder)
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
