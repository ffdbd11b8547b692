"""The test tables seen as operations, logs and key/value tables. Keys and values stay text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETED, FINISHED, NORMAL

#: Every seventh batch of the events log lacks its finish record.
TORN = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _t_ns(column: str) -> F.Column:
    # The tables' times carry no zone: microseconds since the epoch, whatever the session's zone.
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)") * 1000


def _user() -> F.Column:
    return F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 9, "0"))


def _ttl() -> F.Column:
    return F.round(F.col("value") * 100).cast("long") * 6_000_000_000


def events_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as operations on users: signup puts, view puts with a ttl, click expires, purchase persists, error deletes."""
    kinds = {"signup": "put", "view": "put_ttl", "click": "expire", "purchase": "persist"}
    op = F.lit("delete")
    for event, name in kinds.items():
        op = F.when(F.col("event_type") == event, name).otherwise(op)
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), _t_ns("ts").alias("t_ns"), (F.floor(F.col("event_id") / 10) + 1).cast("long").alias("batch_id"), op.alias("op"), _user().alias("key"), F.col("props").alias("value"), _ttl().alias("ttl_ns"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of batches of ten: errors are tombstones, views expire, every seventh batch is torn. seq is twice the event's number, odd for finish records."""
    e = read(spark, sf_dir, "events").withColumn("batch_id", (F.floor(F.col("event_id") / 10) + 1).cast("long"))
    gone = F.col("event_type") == "error"
    seg = F.floor(F.col("event_id") / 1000).cast("int")
    data = e.select(
        (F.col("event_id") * 2).alias("seq"), seg.alias("seg"), F.when(gone, DELETED).otherwise(NORMAL).cast("byte").alias("record_type"), "batch_id",
        _user().alias("key"), F.when(~gone, F.col("props")).alias("value"), F.when(F.col("event_type") == "view", _t_ns("ts") + _ttl()).otherwise(0).alias("expire_ns"),
    )
    ends = e.where(F.col("batch_id") % TORN != 0).groupBy("batch_id").agg(F.max("event_id").alias("last"))
    marks = ends.select(
        (F.col("last") * 2 + 1).alias("seq"), F.floor(F.col("last") / 1000).cast("int").alias("seg"), F.lit(FINISHED).cast("byte").alias("record_type"), F.lit(0).cast("long").alias("batch_id"),
        F.col("batch_id").cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("expire_ns"),
    )
    return data.unionByName(marks)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as records of customers; status F deletes."""
    o = read(spark, sf_dir, "orders")
    gone = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("seq"), F.lit(0).alias("seg"), F.when(gone, DELETED).otherwise(NORMAL).cast("byte").alias("record_type"), F.lit(0).cast("long").alias("batch_id"),
        F.col("o_custkey").cast("string").alias("key"), F.when(~gone, F.col("o_orderpriority")).alias("value"), F.lit(0).cast("long").alias("expire_ns"),
    )


def pages_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"))


def documents_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return read(spark, sf_dir, "documents").select(key.alias("key"), F.col("text").alias("value"))
