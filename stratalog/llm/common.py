"""Shared plumbing: Arrow text buffers, byte-level numpy helpers, and filters of ids."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as numpy arrays at once.
SLICE_BYTES = 1 << 20
#: Rows and bytes of the Arrow batches between Spark and Python, since one text may be long.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"
#: Bits of a filter of ids, which bounds its broadcast.
FILTER_BITS = 1 << 23


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def setting(spark: SparkSession, name: str, default: str) -> str:
    """A path that the session may set as ``stratalog.<name>``."""
    return spark.conf.get(f"stratalog.{name}", default)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    buffers = column.buffers()
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32, count=n + 1, offset=column.offset * (8 if wide else 4))
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each, or one row that is longer; at the end, free memory is given back."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def release() -> None:
    """Give a worker's free memory back to the system; idle workers stay for a minute."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and odd multipliers)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grams(data: np.ndarray, width: int, key: int) -> np.ndarray:
    """A keyed, mixed 64-bit value of the ``width`` bytes (8 at most) from each place on; a bijection of those bytes."""
    n = max(len(data) - width + 1, 0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    x = np.ndarray((n,), "<u8", padded, strides=(1,)).astype(np.uint64)
    if width < 8:
        x &= np.uint64((1 << 8 * width) - 1)
    return mix64(x ^ np.uint64(key))


class Prefixes:
    """Polynomial 64-bit hashes of any run of 64-bit values, in constant time each.

    Over bytes' own values such hashes collide for known texts; callers that do not compare what they find give values
    of several bytes that are mixed before (``grams``), whose differences have no such structure.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        power, self.inverse = self._tables(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            size = max(n, SLICE_BYTES + 1)
            made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64))]
            if size > SLICE_BYTES + 1:  # a long text: not worth keeping
                return made[0], made[1]
            cls._powers[base] = (made[0], made[1])
        return cls._powers[base]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def all_of(self, size: int) -> np.ndarray:
        return mix64((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits that holds the hash of every id (one long column): all ids pass it, and few others while it is sparse."""
    (name,) = ids.columns
    slot = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    words = ids.select(F.floor(slot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.b
    return out


def maybe_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ``ids``: less to shuffle before a join. The bitmap is broadcast; its size is fixed."""
    held = rows.sparkSession.sparkContext.broadcast(id_filter(ids))
    names = rows.columns
    slotted = rows.withColumn("__slot", F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            slot = np.asarray(batch.column("__slot").fill_null(0))
            keep = (bits[slot >> 6] >> (slot & 63)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(names)

    return slotted.mapInArrow(run, rows.schema)
