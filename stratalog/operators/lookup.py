"""Point reads, one key or many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ttl import remaining


def get(live: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of the keys that are live. Repeated keys are found once each. Spark broadcasts the smaller side if its size allows."""
    return keys.select("key").join(live.select("key", "value"), "key", "inner")


def exist(live: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found) of every key asked for."""
    found = live.select("key", F.lit(True).alias("found"))
    return keys.select("key").join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def ttl(live: DataFrame, keys: DataFrame, as_of_ns: int) -> DataFrame:
    """(key, ttl_ns, status): nanoseconds left or -1 without expiry; keys that are absent or expired have -1 and ``not_found``."""
    held = live.select("key", remaining(as_of_ns).alias("left"))
    joined = keys.select("key").join(held, "key", "left")
    return joined.select("key", F.coalesce("left", F.lit(-1).cast("long")).alias("ttl_ns"), F.when(F.col("left").isNull(), "not_found").otherwise("ok").alias("status"))
