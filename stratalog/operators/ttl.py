"""Expiry: the state machine of puts, deletes, expires and persists, as window functions with one exchange by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, EXPIRE, NO_TTL, PERSIST, PUT, PUT_TTL
from .log import expired


def annotate(ops: DataFrame) -> DataFrame:
    """Every operation with what it leads to: expire_ns, grp, base_op, base_value, applied (it found a live key, or opened one), alive (the key has a value afterwards).

    A put or delete opens a group of its key's operations, which only use that group's value. An operation's expiry is
    its own (``put`` and ``persist``: none; ``put_ttl`` and ``expire``: its time plus its ttl). A group is dead from the
    first operation on that meets an expired value, and from the start after a delete.
    """
    opens = F.col("op").isin(PUT, PUT_TTL, DELETE)
    in_key = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    grouped = ops.withColumn("expire_ns", F.when(F.col("op").isin(PUT_TTL, EXPIRE), F.col("t_ns") + F.col("ttl_ns")).otherwise(0)).withColumn("grp", F.sum(opens.cast("int")).over(in_key))
    in_group = Window.partitionBy("key", "grp").orderBy("seq")
    so_far = in_group.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("expire_ns").over(in_group)
    based = grouped.withColumn("base_op", F.first("op").over(so_far)).withColumn("base_value", F.first("value").over(so_far)).withColumn("before", before)
    failed = ~F.col("base_op").isin(PUT, PUT_TTL) | ((F.col("before") > 0) & (F.col("before") <= F.col("t_ns")))
    marked = based.withColumn("dead", F.max(F.coalesce(failed, F.lit(False))).over(so_far))
    return marked.withColumn("alive", ~F.col("dead")).withColumn("applied", opens | F.col("alive")).drop("dead", "before")


def fold(ops: DataFrame) -> DataFrame:
    """(key, value, expire_ns, seq) of keys whose last operation leaves a value, expired ones too."""
    following = F.lead("seq").over(Window.partitionBy("key").orderBy("seq"))
    done = annotate(ops).withColumn("next_seq", following)
    return done.where("next_seq is null and alive").select("key", F.col("base_value").alias("value"), "expire_ns", "seq")


def state_as_of(ops: DataFrame, as_of_ns: int) -> DataFrame:
    """The live keys at a time: operations up to it, folded, without what has expired."""
    return fold(ops.where(F.col("t_ns") <= as_of_ns)).where(~expired(as_of_ns))


def remaining(as_of_ns: int | Column, expire: str = "expire_ns") -> Column:
    """Nanoseconds that a live key still has, or -1 without expiry."""
    return F.when(F.col(expire) == 0, F.lit(NO_TTL).cast("long")).otherwise(F.col(expire) - as_of_ns)


def statuses(ops: DataFrame, op: str) -> DataFrame:
    """(seq, key, status) of all operations of one kind: ``ok``, or ``not_found`` for expire and persist without a live key."""
    found = annotate(ops).where(F.col("op") == op)
    fails = F.lit(False) if op in (PUT, PUT_TTL, DELETE) else ~F.col("applied")
    return found.select("seq", "key", F.when(fails, "not_found").otherwise("ok").alias("status"))


__all__ = ["DELETE", "EXPIRE", "PERSIST", "PUT", "PUT_TTL", "annotate", "expired", "fold", "remaining", "state_as_of", "statuses"]
