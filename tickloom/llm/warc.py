"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

``write_archives`` writes each partition of records as one archive, gzipped as a single stream
(what careless tools produce: no record can be reached without inflating all before it).
``normalise`` inflates each such stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of (offset, length) per record. ``read_records`` seeks to the members.

Streams are handled in blocks of ``BLOCK`` bytes; memory holds one record's payload at most while
writing and one block while normalising. Files are written under a name of the task's attempt and
renamed when complete, so that a repeated or speculative task leaves one whole file. They go to a
shared folder by ``pyarrow.fs``, which opens file, hdfs, s3 (also s3a) and gs paths.

Records (WARC/1.1): ``response`` holds an HTTP block with the payload; ``revisit`` (profile
identical-payload-digest) holds no payload but its digest, length and the record it refers to.

Defined cases: a null payload is empty; an empty table gives empty archives; every row is a record,
also one without an id (its record id is ``urn:page:``) and a repeated one (see ``classify``); payloads of any length and with any bytes survive, also text that looks like
WARC headers, as records are cut by their length alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, aggregate, partitions_for

BLOCK = 1 << 18
GZIP = 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
COPIES = 10_000
INDEX = "path string, offset long, length long, record_id string, record_type string"


def classify(df: DataFrame, key: str, payload: str, stage: Stage, least_bytes: int = 100) -> DataFrame:
    """(key, payload, digest, size, record_type, refers_to): of equal payloads of ``least_bytes`` or more, one row with the smallest key is the response.

    The roles are settled on (key, digest) alone, counted map-side, and written; only rows that are
    no plain response are in that table. It is joined back to the payloads once, by key and digest.
    A row without a key revisits the smallest key; if no equal payload has a key, one such row is
    the response. Of repeated rows (key and payload equal) one is the response, the others revisit
    it: as a revisit holds no payload, these are made from their count.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    d = df.select(F.col(key).alias("key"), F.coalesce(F.col(payload), F.lit("")).alias("payload"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("size"))
    counted = stage.put(d.where(F.col("size") >= least_bytes).groupBy("key", "digest").agg(F.count("*").alias("n"), F.first("size").alias("size")), "counted")
    least = aggregate(counted, ["digest"], F.min("key").alias("refers_to"), F.sum("n").alias("all")).where("all > 1").select("digest", "refers_to")
    roles = counted.join(least, "digest").withColumn("one", F.col("key").eqNullSafe(F.col("refers_to")))
    roles = stage.put(roles.where("NOT one OR n > 1").select(F.col("key").alias("k"), F.col("digest").alias("g"), "refers_to", "one", "n", F.col("size").alias("bytes")), "roles")
    stage.drop("counted")
    joined = d.join(roles.select("k", "g", "refers_to", "one"), d["key"].eqNullSafe(F.col("k")) & (d["digest"] == F.col("g")), "left")
    out = joined.where("one IS NULL OR NOT one").select("key", "payload", "digest", "size", F.when(F.col("one").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")
    doubled = roles.where("one")
    if not doubled.limit(1).count():
        return out
    first = joined.where("one").select("key", "payload", "digest", "size").dropDuplicates(["key", "digest"]).select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    # the rest of a count, in blocks that are dealt out before they become rows
    blocks = doubled.select("*", F.explode(F.expr(f"sequence(0L, (n - 2) div {COPIES})")).alias("b")).repartition(partitions_for(df.sparkSession), "k", "g", "b")
    rest = blocks.select(F.col("k").alias("key"), F.col("g").alias("digest"), F.col("bytes").alias("size"), "refers_to", F.explode(F.expr(f"sequence(1L, least({COPIES}L, n - 1 - b * {COPIES}))")))
    return out.unionByName(first).unionByName(rest.select("key", F.lit("").alias("payload"), "digest", "size", F.lit("revisit").alias("record_type"), "refers_to"))


def record_head(key: int | None, kind: str, digest: str, size: int, refers_to: int | None) -> bytes:
    name = "" if key is None else str(key)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: urn:page:{name}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"X-Payload-Length: {size}"]
        http = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


def parse_head(head: bytes) -> dict[str, str]:
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    return {k.decode().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines if x)}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI; Hadoop's s3a and s3n are s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _open(folder: str, kind: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, temporary path, final path) of this task's file."""
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    t = TaskContext.get()
    part, attempt = (t.partitionId(), t.taskAttemptId()) if t else (0, 0)
    return fs, f"{base}/_{kind}-{part:06d}-{attempt}-{uuid.uuid4().hex[:6]}", f"{base}/{kind}-{part:06d}"


def write_archives(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(path, records) per archive. records: key, payload, digest, size, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, temporary, final = _open(folder, "whole")
        n, z = 0, zlib.compressobj(level, zlib.DEFLATED, GZIP)
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for k in range(batch.num_rows):
                    key, payload, digest, size, kind, refers = (batch.column(c)[k].as_py() for c in range(6))
                    out.write(z.compress(record_head(key, kind, digest, size, refers)))
                    if kind == "response":
                        out.write(z.compress(payload.encode()))
                    out.write(z.compress(b"\r\n\r\n"))
                    n += 1
            out.write(z.flush())
        fs.move(temporary, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], ["path", "records"])

    return records.select("key", "payload", "digest", "size", "record_type", "refers_to").mapInArrow(run, MANIFEST)


class _Stream:
    """Inflates a gzip stream, also one of several members, in blocks."""

    def __init__(self, source):
        self.source, self.z, self.buffer = source, zlib.decompressobj(GZIP), bytearray()

    def more(self) -> bool:
        while True:
            if self.z.eof:
                left = self.z.unused_data or self.source.read(BLOCK)
                if not left:
                    return False
                self.z = zlib.decompressobj(GZIP)
            else:
                left = self.z.unconsumed_tail or self.source.read(BLOCK)
                if not left:
                    return False
            got = self.z.decompress(left, 4 * BLOCK)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes:
        at, seen = -1, 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if not self.buffer:
                    return b""
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(part)
            yield part


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive with a member per record; returns the index rows, also written beside each archive as ``.cdx``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _normalise_one(path)

    def _normalise_one(path: str) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = path.rsplit("/", 1)[1].replace("whole", "records")
        token = uuid.uuid4().hex[:8]
        final, rows, offset = f"{base}/{name}.warc.gz", [], 0
        with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{base}/_{name}-{token}", compression=None) as out, fs.open_output_stream(f"{base}/_{name}-{token}.cdx", compression=None) as side:
            stream = _Stream(source)
            while head := stream.until(b"\r\n\r\n"):
                h = parse_head(head)
                z, length = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0

                def put(data: bytes) -> int:
                    if data:
                        out.write(data)
                    return len(data)

                length += put(z.compress(head))
                for part in stream.take(int(h["content-length"]) + 4):
                    length += put(z.compress(part))
                length += put(z.flush())
                rows.append((final, offset, length, h["warc-record-id"], h["warc-type"]))
                side.write(f"{offset} {length} {h['warc-record-id']} {h['warc-type']}\n".encode())
                offset += length
                if len(rows) >= 20_000:
                    yield _index(rows)
                    rows = []
        fs.move(f"{base}/_{name}-{token}.cdx", f"{final}.cdx")
        fs.move(f"{base}/_{name}-{token}", final)
        if rows:
            yield _index(rows)

    return manifest.select("path").mapInArrow(run, INDEX)


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "offset", "length", "record_id", "record_type"])


def read_records(index: DataFrame, root: str) -> DataFrame:
    """A row per record: key, payload (null of a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response are computed from the bytes read; a record whose bytes do not
    have the digest of its header raises.
    """
    schema = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(root)
        held: dict[str, object] = {}
        for batch in batches:
            rows, size = [], 0
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if path not in held:
                    for f in held.values():
                        f.close()
                    held = {path: fs.open_input_file(path)}
                row = _record(zlib.decompress(held[path].read_at(length, offset), GZIP))
                rows.append(row)
                size += len(row[1] or b"")
                if size > 8 * BLOCK:
                    yield _records(rows)
                    rows, size = [], 0
            if rows:
                yield _records(rows)

    return index.select("path", "offset", "length").mapInArrow(run, schema)


def _record(raw: bytes) -> tuple:
    end = raw.index(b"\r\n\r\n") + 4
    h = parse_head(raw[:end])
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    key = _key(h["warc-record-id"])
    if h["warc-type"] == "revisit":
        return key, None, int(h["x-payload-length"]), digest, "revisit", _key(h["warc-refers-to"])
    body = raw[end : end + int(h["content-length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {key}: the payload does not have its digest")
    return key, payload, len(payload), digest, "response", None


def _key(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return int(name) if name else None


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 100) -> tuple[DataFrame, str]:
    """Write pages as archives, normalise them; (index table, folder)."""
    spark = pages.sparkSession
    stage = Stage(spark, "warc")
    root = stage.path("files")
    manifest = stage.put(write_archives(classify(pages, key, payload, stage, least_bytes), root + "/whole"), "manifest")
    # the whole streams are unsplittable: one task a file
    index = stage.put(normalise(manifest.repartition(partitions_for(spark), "path"), root + "/records"), "index")
    stage.drop("files/whole", "manifest", "roles")
    return index, root
