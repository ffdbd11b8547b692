"""Ordered scans over live or indexed rows. Bounds are plain comparisons, which reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.keys import as_bytes, bound, has_prefix, matches
from ..shared import materialize


def _text(rows: DataFrame) -> bool:
    return rows.schema["key"].dataType.typeName() == "string"


def _at(rows: DataFrame, value: bytes | str | None) -> Column:
    return bound(F.col("key"), as_bytes(value), _text(rows))


def ascend(rows: DataFrame) -> DataFrame:
    return rows.orderBy("key")


def descend(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("key"))


def ascend_range(rows: DataFrame, start: bytes | str | None, end: bytes | str | None) -> DataFrame:
    """Keys in [start, end), ascending; None is the empty key, so an end of None gives nothing."""
    return ascend(rows.where((F.col("key") >= _at(rows, start)) & (F.col("key") < _at(rows, end))))


def descend_range(rows: DataFrame, start: bytes | str | None, end: bytes | str | None) -> DataFrame:
    """Keys in (end, start], descending: ``start`` is the upper bound and belongs to it."""
    return descend(rows.where((F.col("key") <= _at(rows, start)) & (F.col("key") > _at(rows, end))))


def ascend_greater_or_equal(rows: DataFrame, key: bytes | str | None) -> DataFrame:
    return ascend(rows.where(F.col("key") >= _at(rows, key)))


def descend_less_or_equal(rows: DataFrame, key: bytes | str | None) -> DataFrame:
    return descend(rows.where(F.col("key") <= _at(rows, key)))


def ascend_keys(rows: DataFrame, pattern: str | None = None) -> DataFrame:
    """Keys alone, ascending, that contain the pattern; values are never read. Pass live or indexed rows."""
    return ascend(rows.where(matches(F.col("key"), pattern)).select("key"))


def descend_keys(rows: DataFrame, pattern: str | None = None) -> DataFrame:
    return descend(rows.where(matches(F.col("key"), pattern)).select("key"))


def ascend_keys_range(rows: DataFrame, start: bytes | str | None, end: bytes | str | None, pattern: str | None = None) -> DataFrame:
    inside = rows.where((F.col("key") >= _at(rows, start)) & (F.col("key") < _at(rows, end)))
    return ascend_keys(inside, pattern)


def descend_keys_range(rows: DataFrame, start: bytes | str | None, end: bytes | str | None, pattern: str | None = None) -> DataFrame:
    inside = rows.where((F.col("key") <= _at(rows, start)) & (F.col("key") > _at(rows, end)))
    return descend_keys(inside, pattern)


def with_prefix(rows: DataFrame, prefix: bytes | str | None, reverse: bool = False) -> DataFrame:
    found = rows.where(has_prefix(F.col("key"), as_bytes(prefix), _text(rows)))
    return descend(found) if reverse else ascend(found)


def dealt_by_range(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows as a table in the shared folder, dealt by ranges of the first of ``order`` and sorted by all of them.

    ``__part`` rises with the order and ``__at`` numbers the rows of a part from 0 on. Rows that agree in the first of
    ``order`` share a part. It is written at once, since boundaries differ between runs of a range exchange: one pass
    over ``rows``, one exchange.
    """
    dealt = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return materialize(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "dealt")


def _ahead(per_part: DataFrame, amount: str) -> DataFrame:
    """(__part, __offset): the sum of ``amount`` over the parts before; one row a part."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per_part.select("__part", F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias("__offset")))


def _total_order(rows: DataFrame, reverse: bool) -> list[Column]:
    """The key, then every other column that has an order, all in one direction: rows that tie in it are equal. Null keys are last either way."""
    rest = [f.name for f in rows.schema if f.name != "key" and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return [(F.desc_nulls_last if reverse else F.asc_nulls_last)("key"), *((F.desc if reverse else F.asc)(f"`{c}`") for c in rest)]


def ranked(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """The rows with ``rn``, their place from 1 on in key order; parts number their own rows after the counts of the parts before.

    Rows of one key stand in the order of their other columns, so a place depends on the rows alone, not on their files
    or the run, and ``reverse`` is the mirror image but for rows without a key, which come last in both.
    """
    dealt = dealt_by_range(rows, *_total_order(rows, reverse))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    return dealt.join(_ahead(counts, "__n"), "__part").select(*rows.columns, (F.col("__at") + F.col("__offset") + 1).alias("rn"))


def until_bytes(rows: DataFrame, limit: int, column: str = "value") -> DataFrame:
    """The leading rows of an ascending scan up to the first at which the bytes of ``column`` so far exceed ``limit``, that row included.

    The running sum is global. To keep it off a single task, keys are dealt by range and the parts' totals (one row a
    part) are added up; only parts that begin within the limit are summed row by row.
    """
    dealt = dealt_by_range(rows.withColumn("__size", F.coalesce(F.octet_length(column), F.lit(0)).cast("long")), "key")
    totals = dealt.groupBy("__part").agg(F.sum("__size").alias("__total"))
    begun = dealt.join(_ahead(totals, "__total"), "__part").where(F.col("__offset") <= limit)
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = begun.withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return summed.where(F.col("__before") + F.col("__offset") <= limit).select(rows.columns).orderBy("key")


def successors(rows: DataFrame) -> DataFrame:
    """(key, next_key): every key's successor in a scan, null for the last.

    Keys are dealt by range; a part's last key gets the smallest key of the next part that has any.
    """
    dealt = dealt_by_range(rows.select("key"), "key")
    local = dealt.withColumn("__next", F.lead("key").over(Window.partitionBy("__part").orderBy("__at")))
    heads = dealt.groupBy("__part").agg(F.min("key").alias("__head"))
    ahead = heads.withColumn("__first", F.lead("__head").over(Window.orderBy("__part"))).select("__part", "__first")
    return local.join(F.broadcast(ahead), "__part").select("key", F.coalesce("__next", "__first").alias("next_key"))


def seek(rows: DataFrame, probes: DataFrame, reverse: bool = False) -> DataFrame:
    """(probe, key): for each probe the first key at or above it, or with ``reverse`` the last at or below it; null without one.

    Keys and probes are put in one order and the nearest key is carried along: within parts of the key range, and
    over parts by their first (last) keys. So there is no join by inequality.
    """
    name = probes.columns[0]
    # At the same place, a key comes where its probes find it.
    keys = rows.select(F.col("key").alias("__k"), F.lit(0 if reverse else 1).alias("__kind"), F.col("key").alias("__key"))
    asked = probes.select(F.col(name).alias("__k"), F.lit(1 if reverse else 0).alias("__kind"), F.lit(None).cast(rows.schema["key"].dataType).alias("__key"))
    both = dealt_by_range(keys.unionByName(asked), "__k", "__kind")
    inside = Window.partitionBy("__part").orderBy("__at")
    if reverse:
        near = F.last("__key", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        edge, beyond = F.max("__key"), F.last("__edge", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    else:
        near = F.first("__key", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
        edge, beyond = F.min("__key"), F.first("__edge", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing))
    local = both.withColumn("__near", near)
    edges = both.groupBy("__part").agg(edge.alias("__edge")).withColumn("__beyond", beyond).select("__part", "__beyond")
    return local.where(F.col("__kind") == (1 if reverse else 0)).join(F.broadcast(edges), "__part").select(F.col("__k").alias("probe"), F.coalesce("__near", "__beyond").alias("key"))


def run(rows: DataFrame, handler: Callable[[bytes, bytes | None], bool]) -> None:
    """Call ``handler(key, value)`` for the rows of an ordered scan until it returns False; its errors are raised.

    Rows come to the driver partition by partition, not all at once.
    """
    for r in rows.select("key", "value").toLocalIterator():
        if not handler(bytes(r.key) if not isinstance(r.key, str) else r.key, r.value):
            break


class Cursor:
    """A driver-side cursor over a snapshot: rewind, seek, next, valid, item, close.

    Positioned on the first row when made. Seeking is a new bounded scan, and does nothing once the cursor is exhausted
    until it is rewound. Methods are safe after ``close``.
    """

    def __init__(self, rows: DataFrame, prefix: bytes | str | None = None, reverse: bool = False):
        self.rows = rows.where(has_prefix(F.col("key"), as_bytes(prefix), _text(rows)))
        self.reverse = reverse
        self.error: Exception | None = None
        self.closed = False
        self._rows: Iterator[Row] = iter(())
        self._now: Row | None = None
        self.rewind()

    def _open(self, rows: DataFrame) -> None:
        ordered = descend(rows) if self.reverse else ascend(rows)
        self._rows = ordered.select("key", "value").toLocalIterator()
        self.next()

    def rewind(self) -> None:
        if not self.closed:
            self._open(self.rows)

    def seek(self, key: bytes | str | None) -> None:
        if not self.closed and self._now is not None:
            at = _at(self.rows, key)
            self._open(self.rows.where(F.col("key") <= at if self.reverse else F.col("key") >= at))

    def next(self) -> None:
        if not self.closed:
            try:
                self._now = next(self._rows, None)
            except Exception as e:  # kept for err(), as the cursor ends here
                self.error, self._now = e, None

    def valid(self) -> bool:
        return not self.closed and self._now is not None

    def item(self) -> Row | None:
        return self._now if self.valid() else None

    def err(self) -> Exception | None:
        return self.error

    def close(self) -> None:
        self.closed, self._now, self._rows = True, None, iter(())
