"""Options of stores, batches and iterators."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidOptions
from .functions.cron import check_cron


@dataclass(frozen=True)
class Options:
    """``path``: folder of the store. ``watch_queue_size``: 0 turns the feed off.

    A segment ends with the commit that brings it to ``segment_bytes`` of files or ``segment_rows`` rows.
    ``auto_merge_cron``: when an open store compacts itself. ``sync`` and ``bytes_per_sync`` are accepted: commits are
    durable anyway. ``shuffle_partitions``: partitions of the sorted snapshot, None for the session's.
    """

    path: str
    segment_rows: int = 10_000_000
    segment_bytes: int = 1 << 30
    bytes_per_sync: int = 0
    watch_queue_size: int = 0
    auto_merge_cron: str = ""
    sync: bool = False
    shuffle_partitions: int | None = None

    def __post_init__(self) -> None:
        if not self.path:
            raise InvalidOptions("the path is empty")
        if self.segment_rows <= 0 or self.segment_bytes <= 0:
            raise InvalidOptions("segments need at least one row and one byte")
        if self.watch_queue_size < 0:
            raise InvalidOptions("the watch queue's size is negative")
        if self.auto_merge_cron:
            check_cron(self.auto_merge_cron)


@dataclass(frozen=True)
class BatchOptions:
    sync: bool = True
    read_only: bool = False


@dataclass(frozen=True)
class IteratorOptions:
    """``continue_on_error`` skips unreadable files (Spark's ``ignoreCorruptFiles``)."""

    prefix: bytes | None = None
    reverse: bool = False
    continue_on_error: bool = False
