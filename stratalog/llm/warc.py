"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of which holds whole records, and a footer: a skippable frame
with the seek table (compressed and decompressed size of every frame). An index maps record ids to the bundle, the
frame and the offset inside the decompressed frame, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Decompressed bytes after which a frame, and a bundle, is closed.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Equal payloads from this length on are stored once.
REVISIT_BYTES = 1000
#: Tasks over which the rows of one payload are dealt.
SALTS = 32
#: Reading tasks a core at most.
TASKS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) sizes; no checksums."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of every frame of a bundle, an open file."""
    bundle.seek(0, 2)
    end = bundle.tell()
    bundle.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    each = 12 if flags & 0x80 else 8
    bundle.seek(end - 9 - n * each)
    table, out, start = bundle.read(n * each), [], 0
    for i in range(n):
        size, full = struct.unpack_from("<II", table, i * each)
        out.append((start, size, full))
        start += size
    return out


def record_bytes(row_id: int | None, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header with the length of the payload that it refers to."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    block = b"\r\n".join(head) + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Identified-Payload-Key: {'' if row_id is None else row_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 37))) + ''.join(map(chr, range(38, 127))))}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        cut = block.index(b"\r\n\r\n") + 4
        http = dict(x.split(b": ", 1) for x in block[:cut].split(b"\r\n")[1:] if x)
        key, to, url = head["WARC-Identified-Payload-Key"], head.get("WARC-Refers-To"), head.get("WARC-Target-URI")
        yield {
            "id": int(key) if key else None, "record_id": head["WARC-Record-ID"].strip("<>"), "record_type": head["WARC-Type"],
            "url": None if url is None else unquote(url), "declared_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "declared_bytes": int(http[b"Content-Length"]), "payload": block[cut:] if to is None else None,
            "refers_to": None if to is None else int(to.split(":")[2]),
        }
        at = end + 4 + size + 4


class _Bundle:
    """Collects records into frames and writes one bundle under a name of its own."""

    def __init__(self, folder: str):
        self.name, self.folder = f"{uuid.uuid4().hex}.warc.zst", folder
        self.done, self.frames, self.open, self.rows, self.total = [], [], [], [], 0
        self.pack = zstandard.ZstdCompressor(level=3)
        self.size = 0

    def add(self, row_id, record_id: str, record: bytes) -> None:
        self.rows.append([row_id, record_id, self.name, len(self.frames), self.total, 0, self.size, len(record)])
        self.open.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.pack.compress(b"".join(self.open))
            for r in reversed(self.rows):
                if r[3] != len(self.frames):
                    break
                r[5] = len(packed)
            self.done.append(packed)
            self.frames.append((len(packed), self.size))
            self.total += len(packed)
            self.open, self.size = [], 0

    def write(self) -> list[list]:
        self.close_frame()
        to, path = fs.FileSystem.from_uri(self.folder)
        with to.open_output_stream(f"{path}/{self.name}", compression=None) as out:
            out.write(b"".join(self.done) + seek_table(self.frames))
        return self.rows


def decide_revisits(pages: DataFrame, row_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to): of equal payloads of 1000 bytes or more, all but the one with the largest id refer to that one.

    Null payloads are empty. Rows with a null id are responses of their own. Repeated rows of the largest id are all
    responses. The largest id of a payload is found with partial aggregates, and the payloads are joined to it dealt
    by digest and a salt, so that a payload of a third of all rows is spread over ``SALTS`` tasks.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(body, "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    largest = rows.where((F.col("n") >= REVISIT_BYTES) & F.col("id").isNotNull()).groupBy("digest", "n").agg(F.max("id").alias("response_id"), F.count("*").alias("rows")).where("rows > 1")
    largest = largest.select(F.col("digest").alias("d"), F.col("n").alias("m"), "response_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(largest.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")) & (F.col("salt") == F.col("s")), "left")
    refers = F.when(F.col("id") < F.col("response_id"), F.col("response_id"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder as a full URI, as Python's file systems take it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if re.match("file:/[^/]", uri) else uri


def write_archive(decided: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``decide_revisits`` as bundles in ``folder``, a URI that all executors reach; returns the record index.

    The index is written to ``folder/index`` and read back. A task that is run again writes bundles under new names;
    only the names in the index count, so bundles of lost attempts are never read. A record's id holds the row's id and
    its payload's digest, so rows that repeat an id with other payloads have ids of their own; rows that repeat both are
    one record written again.
    """
    spark = decided.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    where = _uri(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(bundle: _Bundle) -> pa.RecordBatch:
            rows = bundle.write()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        bundle = _Bundle(where)
        written = 0
        for batch in slices(batches, "payload"):
            for row_id, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                record_id = f"urn:page:{row_id}:{digest}" if row_id is not None else f"urn:uuid:{uuid.uuid4()}"
                record = record_bytes(row_id, record_id, url, payload, digest, refers)
                bundle.add(row_id, record_id, record)
                written += len(record)
                if written >= BUNDLE_BYTES:
                    yield flush(bundle)
                    bundle, written = _Bundle(where), 0
        if bundle.rows:
            yield flush(bundle)

    index = decided.mapInArrow(run, INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All records of an archive, read from its bundles frame by frame.

    Columns: id, record_id, record_type, url, payload_bytes and payload_digest (computed from the payload that was read
    for responses, declared by the record for revisits, whose payload is elsewhere), refers_to, payload (null for
    revisits). An archive without records gives no rows.
    """
    schema = "id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    bundles = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index").select("bundle").distinct()
    # Names are small, so Spark would merge them into a few tasks; a bundle is the work of one.
    bundles = bundles.repartition(max(1, min(bundles.count(), TASKS * spark.sparkContext.defaultParallelism)))
    where = _uri(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(where)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{bundle}") as f:
                    for start, size, full in read_seek_table(f):
                        f.seek(start)
                        out = []
                        for r in parse_records(unpack.decompress(f.read(size), max_output_size=full)):
                            body = r["payload"]
                            n, digest = (r["declared_bytes"], r["declared_digest"]) if body is None else (len(body), hashlib.sha1(body).hexdigest())
                            out.append((r["id"], r["record_id"], r["record_type"], r["url"], n, digest, r["refers_to"], body))
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return bundles.mapInArrow(run, schema)


def read_records(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """The records whose id is in ``ids`` (one column), by seeking: each frame that holds some is read once, and no other."""
    name = ids.columns[0]
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    wanted = index.join(ids.select(F.col(f"`{name}`").cast("long").alias("id")).distinct(), "id", "left_semi")
    # A frame's records are few, since frames are closed at a size.
    frames = wanted.groupBy("bundle", "frame_start", "frame_bytes").agg(F.collect_list(F.struct("record_start", "record_bytes")).alias("records"))
    frames = frames.sortWithinPartitions("bundle", "frame_start")
    schema = "id long, record_type string, payload binary"
    where = _uri(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(where)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, group in itertools.groupby(batch.to_pylist(), key=lambda r: r["bundle"]):
                with store.open_input_file(f"{path}/{bundle}") as f:
                    for r in group:
                        f.seek(r["frame_start"])
                        frame = unpack.decompress(f.read(r["frame_bytes"]))
                        found = [next(parse_records(frame[x["record_start"] : x["record_start"] + x["record_bytes"]])) for x in r["records"]]
                        yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x in found], pa.int64()), pa.array([x["record_type"] for x in found]), pa.array([x["payload"] for x in found], pa.binary())], ["id", "record_type", "payload"])

    return frames.mapInArrow(run, schema)
