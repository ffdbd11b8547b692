"""The binary record encoding: type, batch id, sizes and expiry as variable-length integers, then key and value.

A Python data source reads files of length-prefixed records, which is how exported logs come; block framing of a
foreign log is not known here. Files are read through Arrow's file systems, by the executors that get them, in batches.
"""

from __future__ import annotations

import itertools
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Record:
    record_type: int
    batch_id: int
    key: bytes
    value: bytes
    expire_ns: int = 0


def _uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _zigzag(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def _unzigzag(n: int) -> int:
    return n >> 1 if not n & 1 else -(n >> 1) - 1


def encode(r: Record) -> bytes:
    """Type byte, unsigned batch id, then signed key size, value size and expiry, key, value."""
    sizes = b"".join(_uvarint(_zigzag(n)) for n in (len(r.key), len(r.value), r.expire_ns))
    return bytes([r.record_type]) + _uvarint(r.batch_id) + sizes + r.key + r.value


def decode(data: bytes) -> Record:
    batch_id, at = _read_uvarint(data, 1)
    sizes = []
    for _ in range(3):
        n, at = _read_uvarint(data, at)
        sizes.append(_unzigzag(n))
    key_size, value_size, expire = sizes
    return Record(data[0], batch_id, data[at : at + key_size], data[at + key_size : at + key_size + value_size], expire)


#: Records of an Arrow batch, and bytes that a file is read by.
BATCH, BUFFER = 4096, 1 << 20
_SCHEMA = pa.schema([("seq", pa.int64()), ("seg", pa.int32()), ("record_type", pa.int8()), ("batch_id", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("expire_ns", pa.int64())])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        store, path = open_store(self.path)
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f.base_name, f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [_File(p, i) for i, (_, p) in enumerate(files)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        with store.open_input_stream(partition.path, buffer_size=BUFFER) as f:
            rows: list[tuple] = []
            n = 0
            while head := f.read(4):
                r = decode(f.read(struct.unpack("<I", head)[0]))
                rows.append(((partition.number << 40) + n, partition.number, r.record_type, r.batch_id, r.key, r.value, r.expire_ns))
                n += 1
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


class RecordSource(DataSource):
    """``spark.dataSource.register(RecordSource)``, then ``spark.read.format("records").load(folder)``; a file is a segment, in order of names."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "seq long, seg int, record_type byte, batch_id long, key binary, value binary, expire_ns long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def write_segment(path: str, records: list[Record]) -> None:
    """A file of length-prefixed records, under a path or URI."""
    store, inside = open_store(path)
    with store.open_output_stream(inside) as f:
        for r in records:
            data = encode(r)
            f.write(struct.pack("<I", len(data)) + data)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder of segments; workers get this module with the plan, so they need not find it."""
    _by_value()
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").load(folder)


def write_segments(log: DataFrame, folder: str) -> int:
    """Write a log (seg, seq, record_type, batch_id, key, value, expire_ns) as one file a segment, records in order of seq; returns their number.

    A segment is the work of one task. Null values are empty. A task that is run again writes its files again.
    """
    _by_value()
    rows = log.select("seg", "record_type", "batch_id", F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), "expire_ns", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = open_store(folder)
        store.create_dir(inside, recursive=True)
        records = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        for seg, group in itertools.groupby(records, key=lambda r: r[0]):
            n = 0
            with store.open_output_stream(f"{inside}/{seg:010d}") as f:
                for _, *fields in group:
                    data = encode(Record(*fields))
                    f.write(struct.pack("<I", len(data)) + data)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.repartition("seg").sortWithinPartitions("seg", "seq").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _by_value() -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
