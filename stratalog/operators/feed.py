"""Change events of committed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACTION_DELETE, ACTION_PUT, DELETED
from .log import committed


def events(log: DataFrame) -> DataFrame:
    """(action, key, value, batch_id, seq): one event a committed record, in the order of seq; deletes carry no value."""
    dropped = F.col("record_type") == DELETED
    return committed(log).select(F.when(dropped, ACTION_DELETE).otherwise(ACTION_PUT).cast("byte").alias("action"), "key", F.when(~dropped, F.col("value")).alias("value"), "batch_id", "seq")


def batch_summary(feed: DataFrame) -> DataFrame:
    """(batch_id, n_puts, n_deletes, first_seq, last_seq)."""
    puts = F.sum((F.col("action") == ACTION_PUT).cast("long")).alias("n_puts")
    return feed.groupBy("batch_id").agg(puts, F.sum((F.col("action") == ACTION_DELETE).cast("long")).alias("n_deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def bounded(feed: DataFrame, capacity: int) -> DataFrame:
    """What a ring of ``capacity`` places still holds, newest first: the last ``capacity - 2`` events. The loss is the feature; the plain feed keeps all."""
    return feed.orderBy(F.desc("seq")).limit(max(capacity - 2, 0))
