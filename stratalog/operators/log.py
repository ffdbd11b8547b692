"""From the log of records to the latest state: committed records, latest per key, and what keys still count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETED, FINISHED, NORMAL


def expired(as_of_ns: int | Column, expire: str | Column = "expire_ns") -> Column:
    """A record is expired from its expiry time on; 0 is never."""
    e = F.col(expire) if isinstance(expire, str) else expire
    return (e > 0) & (e <= as_of_ns)


def segments(log: DataFrame, after: int | None = None, up_to: int | None = None) -> DataFrame:
    """The records of a range of segments; on a log stored by segment this prunes folders."""
    if after is not None:
        log = log.where(F.col("seg") > after)
    return log if up_to is None else log.where(F.col("seg") <= up_to)


def finish_marks(log: DataFrame) -> DataFrame:
    """(batch_id, fin_seq): the last finish record of each batch; its key is the batch's number in digits."""
    return log.where(F.col("record_type") == FINISHED).select(F.col("key").cast("string").cast("long").alias("batch_id"), "seq").groupBy("batch_id").agg(F.max("seq").alias("fin_seq"))


def committed(log: DataFrame) -> DataFrame:
    """Data records that a finish record of their batch follows, and normal ones of batch 0, which compaction wrote.

    The marks are one row a batch. Spark chooses how to join them from their measured size.
    """
    data = log.where(F.col("record_type") != FINISHED)
    whole = (F.col("batch_id") != 0) & (F.col("fin_seq") > F.col("seq"))
    merged = (F.col("batch_id") == 0) & (F.col("record_type") == NORMAL)
    # Batch 0 has no mark; keys of their own spread its rows, which may be most of the log.
    marks = finish_marks(log).withColumnRenamed("batch_id", "mark")
    key = F.when(F.col("batch_id") != 0, F.col("batch_id")).otherwise(-1 - F.col("seq"))
    return data.join(marks, key == F.col("mark"), "left").where(whole | merged).select(log.columns)


def torn(log: DataFrame) -> DataFrame:
    """Data records whose batch no finish record completes."""
    data = log.where((F.col("record_type") != FINISHED) & (F.col("batch_id") != 0))
    marks = finish_marks(log)
    return data.join(marks, (data.batch_id == marks.batch_id) & (marks.fin_seq > data.seq), "left_anti")


def newest(records: DataFrame) -> DataFrame:
    """The newest record of each key, tombstones too.

    Top one of a window: Spark cuts each task's rows to one a key before the exchange, so a hot key costs one row a task.
    """
    latest_first = Window.partitionBy("key").orderBy(F.desc("seq"))
    return records.withColumn("__n", F.row_number().over(latest_first)).where("__n = 1").drop("__n")


def latest(records: DataFrame) -> DataFrame:
    """The newest record of each key that is no tombstone, expired or not."""
    return newest(records).where(F.col("record_type") != DELETED)


def live(records: DataFrame, as_of_ns: int) -> DataFrame:
    """``latest`` without what has expired at ``as_of_ns``."""
    return latest(records).where(~expired(as_of_ns))


def override(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """A snapshot under newer records: the newest of both per key. Tombstones of the tail count, and then go."""
    columns = ["key", "value", "expire_ns", "seq", "record_type"]
    base = snapshot.withColumn("record_type", F.lit(NORMAL).cast("byte"))
    return latest(base.select(columns).unionByName(tail.select(columns)))
