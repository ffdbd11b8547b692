"""The change feed as a stream, and the live state kept by a stateful processor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import ACTION_DELETE, ACTION_PUT, DELETE, EXPIRE, PERSIST, PUT, PUT_TTL

_COMMIT = "n long, t_ns long, batch_id long, op string, key binary, value binary, ttl_ns long"


def watch(spark: SparkSession, root: str) -> DataFrame:
    """Committed operations of a store as they arrive. Folders appear in ``log`` only once their commit is published."""
    rows = spark.readStream.schema(_COMMIT).parquet(f"{root}/log/*")
    gone = F.col("op") == DELETE
    return rows.select(F.when(gone, ACTION_DELETE).otherwise(ACTION_PUT).cast("byte").alias("action"), "op", "key", "value", "batch_id", "t_ns", "ttl_ns", "n")


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


class _Fold(StatefulProcessor):
    """Per key: value, expiry and whether it lives, advanced by every operation in order of seq.

    Expiry is decided by the operations' own times, never by the clock, so results do not depend on when batches run.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string, expire_ns bigint, alive boolean, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, expire, alive, seq = self.state.get() if self.state.exists() else (None, 0, False, -1)
        for op in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if alive and 0 < expire <= op.t_ns:
                alive = False
            if op.op == PUT:
                value, expire, alive = op.value, 0, True
            elif op.op == PUT_TTL:
                value, expire, alive = op.value, int(op.t_ns + op.ttl_ns), True
            elif op.op == DELETE:
                value, expire, alive = None, 0, False
            elif op.op == EXPIRE and alive:
                expire = int(op.t_ns + op.ttl_ns)
            elif op.op == PERSIST and alive:
                expire = 0
            seq = int(op.seq)
        self.state.update((value, expire, alive, seq))
        yield pd.DataFrame({"key": [key[0]], "value": [value if alive else None], "expire_ns": [expire], "alive": [alive], "seq": [seq]})

    def close(self) -> None:
        pass


STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_stream(ops: DataFrame) -> DataFrame:
    """The state of every key that a micro-batch touches: key, value, expire_ns, alive, seq (update mode).

    ``ops``: seq, t_ns, op, key, value, ttl_ns, with text keys and values. A key's operations must come in order of seq
    over micro-batches. Needs the RocksDB state store (``STATE_PROVIDER``).
    """
    return ops.groupBy("key").transformWithStateInPandas(_Fold(), "key string, value string, expire_ns bigint, alive boolean, seq bigint", "Update", "None")


def run_batches(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Process all that is there in micro-batches, passing each result to ``sink``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
