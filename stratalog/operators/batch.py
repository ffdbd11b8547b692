"""Batches as relations: last operation per key, and rolled-back batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_op_wins(staged: DataFrame) -> DataFrame:
    """Of each batch's operations on a key, the last; what a batch writes."""
    last = Window.partitionBy("batch_id", "key").orderBy(F.desc("seq"))
    return staged.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def without_batches(staged: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """Operations without those of rolled-back batches (one column of batch ids)."""
    return staged.join(rolled_back.select("batch_id").distinct(), "batch_id", "left_anti")
