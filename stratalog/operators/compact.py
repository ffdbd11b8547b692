"""Compaction, purge and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETED, FINISHED
from .log import committed, expired, latest, live, newest, segments


def merge_live(log: DataFrame, up_to: int, as_of_ns: int) -> DataFrame:
    """What a compaction of the segments up to ``up_to`` keeps: the live rows (key, value, expire_ns, seq).

    Tombstones go, since everything older is compacted with them.
    """
    return live(committed(segments(log, up_to=up_to)), as_of_ns).select("key", "value", "expire_ns", "seq", "seg")


def hint(snapshot: DataFrame) -> DataFrame:
    """(key, seq) of a snapshot: a projection that reads no values."""
    return snapshot.select("key", "seq")


def garbage_by_segment(log: DataFrame, as_of_ns: int) -> DataFrame:
    """(seg, records, live, garbage): data records that a compaction would keep and drop."""
    keep = live(committed(log), as_of_ns).groupBy("seg").agg(F.count("*").alias("live"))
    data = log.where(F.col("record_type") != FINISHED).groupBy("seg").agg(F.count("*").alias("records"))
    kept = F.coalesce("live", F.lit(0))
    return data.join(keep, "seg", "left").select("seg", "records", kept.alias("live"), (F.col("records") - kept).alias("garbage"))


def purge(indexed: DataFrame, as_of_ns: int) -> DataFrame:
    """Indexed keys without the expired ones, in one pass."""
    return indexed.where(~expired(as_of_ns))


def purge_page(indexed: DataFrame, as_of_ns: int, cursor: bytes | str | None = None, size: int = 100) -> DataFrame:
    """One page of a paged purge: of the ``size`` keys from the cursor on, those that have expired. Page sizes are a feature here."""
    from .scan import ascend_greater_or_equal

    return ascend_greater_or_equal(indexed.select("key", "expire_ns"), cursor).limit(size).where(expired(as_of_ns)).select("key")


def stat(log: DataFrame) -> DataFrame:
    """One row: keys_num (indexed keys, expired ones too) and disk_size (bytes of keys and values in the log)."""
    size = log.agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("disk_size"))
    # Values are not needed to count keys.
    keys = newest(committed(log.drop("value"))).where(F.col("record_type") != DELETED).agg(F.count("*").alias("keys_num"))
    return keys.join(size)


__all__ = ["garbage_by_segment", "hint", "latest", "merge_live", "purge", "purge_page", "stat"]
