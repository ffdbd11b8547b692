"""Deterministic test keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def test_key(i: Column, prefix: str = "stratalog-test-key-") -> Column:
    """A fixed text and nine digits."""
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), 9, "0")).cast("binary")


test_key.__test__ = False


def test_value(i: Column, n: int, prefix: str = "stratalog-value--:") -> Column:
    """A fixed text of 18 characters and n letters and digits that depend on i alone."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0) // 64)), lambda k: F.sha2(F.concat_ws(":", i, k), 256))
    return F.concat(F.lit(prefix), F.substring(F.array_join(blocks, ""), 1, n)).cast("binary")


test_value.__test__ = False


def key_values(spark: SparkSession, n: int, size: int) -> DataFrame:
    """n rows (key, value), made on the executors."""
    i = F.col("id")
    return spark.range(n).select(test_key(i).alias("key"), test_value(i, size).alias("value"))


def hash_key(key: Column) -> Column:
    """A 64-bit hash of key bytes, the same in every process."""
    return F.xxhash64(key)
