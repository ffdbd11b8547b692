"""A keyed table on shared storage: immutable files of operations, a sorted snapshot, and versioned manifests.

    path/manifest/v<version>.json   what a version consists of; the file appears whole, and that is the commit
    path/log/<commit>/              operations of one commit, as Parquet
    path/snapshot/<id>/             live rows of a compaction, dealt and sorted by key

Writers give the next manifest its name, which only one can; a loser reads again and repeats its own publish, or gives up
after ``RETRIES``. A manifest that is torn all the same (by a storage that failed) does not count: the last whole one
does. Readers see one version. Every read is a DataFrame over the snapshot and the operations after it. The file system
needs an atomic rename that does not overwrite, as HDFS and local ones have.
"""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .config import BatchOptions, IteratorOptions, Options
from .errors import BatchCommitted, BatchRollbacked, DatabaseIsUsing, DBClosed, KeyIsEmpty, KeyNotFound, MergeRunning, ReadOnlyBatch, WatchDisabled
from .functions.cron import next_time
from .functions.keys import as_key, check_pattern
from .operators import compact, feed, lookup, scan, ttl
from .operators.log import expired
from .schema import ACTION_DELETE, ACTION_PUT, DELETE, EXPIRE, NO_TTL, OPS, PERSIST, PUT, PUT_TTL, SNAPSHOT

RETRIES = 20
#: Columns of a stored operation: those of ``OPS`` and its segment.
STORED = "seq long, seg int, t_ns long, batch_id long, op string, key binary, value binary, ttl_ns long"


class Files:
    """The few file operations that commits need, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put a whole new file under a name that nobody has taken; False if someone has.

        It is written under another name first, which then becomes this one in one step.
        """
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            return self._name(draft, name)
        finally:
            self.fs.delete(self._path(draft), False)

    def _name(self, draft: str, name: str) -> bool:
        old, new = (self.fs.makeQualified(self._path(x)) for x in (draft, name))
        if new.toUri().getScheme() == "file":
            try:
                os.link(old.toUri().getPath(), new.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm, conf = self.jvm, self.fs.getConf()
        options = self.jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(old, new, options)
        except Exception as e:
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                return False
            raise
        return True

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._path(new).getParent())
        self.fs.rename(self._path(old), self._path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0


class Store:
    """Open with ``Store.open(spark, options)``. Times are nanoseconds; ``clock`` gives the present for verbs without an explicit time."""

    def __init__(self, spark: SparkSession, options: Options, clock: Callable[[], int] = time.time_ns):
        self.spark, self.options, self.clock = spark, options, clock
        self.files = Files(spark, options.path)
        self.closed = self.merging = False
        self._queries: list[StreamingQuery] = []
        self._skip_corrupt = False
        self._over = threading.Event()
        self._merger: threading.Thread | None = None
        if not self._versions():
            self.files.create(f"manifest/{_name(0)}", json.dumps({"version": 0, "log": [], "snapshot": None, "next_seq": 1, "seg": 0, "seg_rows": 0, "seg_bytes": 0, "purged_ns": 0}))
        held = set(self.files.list("log"))
        for entry in self._manifest()["log"]:
            if entry["dir"] not in held:
                self._settle(entry["dir"])
        if options.auto_merge_cron:
            self._merger = threading.Thread(target=self._merge_in_time, daemon=True)
            self._merger.start()

    @classmethod
    def open(cls, spark: SparkSession, options: Options | str, clock: Callable[[], int] = time.time_ns) -> Store:
        return cls(spark, Options(options) if isinstance(options, str) else options, clock)

    def close(self) -> None:
        """End the store's own feeds and compactions; verbs raise from now on."""
        self.closed = True
        self._over.set()
        for q in self._queries:
            q.stop()
        if self._merger and self._merger is not threading.current_thread():
            self._merger.join()

    def _merge_in_time(self) -> None:
        """Compact whenever the schedule says so, until the store is closed."""
        while (due := next_time(self.options.auto_merge_cron, self.clock())) is not None:
            while (left := (due - self.clock()) / 1e9) > 0:
                if self._over.wait(min(left, 1.0)):
                    return
            with contextlib.suppress(MergeRunning, DBClosed, DatabaseIsUsing):
                self.merge()
            if self._over.is_set():
                return

    def sync(self) -> None:
        """Nothing to do: a commit is durable when its manifest is there."""
        self._check()

    def _check(self) -> None:
        if self.closed:
            raise DBClosed("the store is closed")

    # Versions.

    def _versions(self) -> list[str]:
        return [n for n in self.files.list("manifest") if n.startswith("v")]

    def _manifest(self, names: list[str] | None = None) -> dict:
        """The newest whole manifest."""
        for name in reversed(self._versions() if names is None else names):
            with contextlib.suppress(ValueError):
                return json.loads(self.files.read(f"manifest/{name}"))
        raise DatabaseIsUsing("no manifest is whole")

    def _publish(self, change: Callable[[dict], dict]) -> dict:
        for _ in range(RETRIES):
            names = self._versions()
            now = self._manifest(names)
            new = change(dict(now)) | {"version": int(names[-1][1:-5]) + 1}
            if self.files.create(f"manifest/{_name(new['version'])}", json.dumps(new)):
                return new
        raise DatabaseIsUsing("other writers keep publishing first")

    def _settle(self, name: str) -> None:
        """Move a committed folder to its place, if its writer did not get to it."""
        if not self.files.exists(f"log/{name}") and self.files.exists(f"staging/{name}"):
            self.files.move(f"staging/{name}", f"log/{name}")

    def write(self, ops: DataFrame, order: str | None = None) -> int:
        """Commit a DataFrame (op, key, value, ttl_ns) as one batch; returns its id.

        With ``order``, operations on a key apply in that column's order, and the last of them counts, as in a batch;
        without, keys must not repeat. Rows are numbered on the executors, so the numbers have gaps. Expires and persists
        store the value that their key has now, for the feed.
        """
        self._check()
        columns = ops.columns
        rows = ops.select(F.col("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), (F.col("ttl_ns") if "ttl_ns" in columns else F.lit(0)).cast("long").alias("ttl_ns"), *([F.col(order).alias("__order")] if order else []))
        if order:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("op", "value", "ttl_ns"), "__order").alias("o")).select("o.op", "key", "o.value", "o.ttl_ns")
        bad = F.raise_error(F.lit("KeyIsEmpty"))
        rows = rows.withColumn("key", F.when(F.octet_length("key") > 0, F.col("key")).otherwise(bad))
        kept = F.col("op").isin(EXPIRE, PERSIST)
        if not rows.where(kept).isEmpty():
            now = self.live().select("key", F.col("value").alias("__now"))
            rows = rows.join(now, "key", "left").withColumn("value", F.when(kept, F.col("__now")).otherwise(F.col("value"))).drop("__now")
        return self._commit(rows.withColumn("n", F.monotonically_increasing_id()))

    def _commit(self, rows: DataFrame) -> int:
        """``rows``: op, key, value, ttl_ns, n. Numbers are relative in the file and absolute by the manifest's ``first``."""
        name, t, batch_id = uuid.uuid4().hex, self.clock(), uuid.uuid4().int >> 65
        out = rows.select(F.col("n").cast("long").alias("n"), F.lit(t).cast("long").alias("t_ns"), F.lit(batch_id).cast("long").alias("batch_id"), "op", "key", "value", "ttl_ns")
        try:
            out.write.parquet(f"{self.files.root}/staging/{name}")
        except Exception as e:
            self.files.delete(f"staging/{name}")
            if "KeyIsEmpty" in str(e):
                raise KeyIsEmpty("a key needs at least one byte") from None
            raise
        size = self.files.size(f"staging/{name}")
        top, count = self.spark.read.parquet(f"{self.files.root}/staging/{name}").agg(F.coalesce(F.max("n"), F.lit(-1)), F.count("*")).first()

        def add(m: dict) -> dict:
            full = m["seg_rows"] >= self.options.segment_rows or m.get("seg_bytes", 0) >= self.options.segment_bytes
            seg, rows, held = (m["seg"] + 1, 0, 0) if full else (m["seg"], m["seg_rows"], m.get("seg_bytes", 0))
            return m | {"log": [*m["log"], {"dir": name, "seg": seg, "first": m["next_seq"], "rows": count}], "next_seq": m["next_seq"] + top + 1, "seg": seg, "seg_rows": rows + count, "seg_bytes": held + size}

        self._publish(add)
        self._settle(name)
        return batch_id

    # Relations.

    @property
    def _read(self):
        """A reader of this store's files."""
        return self.spark.read.option("ignoreCorruptFiles", self._skip_corrupt)

    def ops(self, version: dict | None = None, after: int | None = None, up_to: int | None = None) -> DataFrame:
        """The operations since the snapshot, numbered in commit order; of segments beyond ``after`` and up to ``up_to``, whose folders alone are read."""
        m = version or self._manifest()
        at = {e["dir"]: e for e in m["log"] if (after is None or e["seg"] > after) and (up_to is None or e["seg"] <= up_to)}
        if not at:
            return self.spark.createDataFrame([], STORED)
        there = set(self.files.list("log"))
        where = [f"{self.files.root}/{'log' if d in there else 'staging'}/{d}" for d in at]
        rows = self._read.schema("n long, t_ns long, batch_id long, op string, key binary, value binary, ttl_ns long").parquet(*where)
        commits = F.broadcast(self.spark.createDataFrame([(d, e["first"], e["seg"]) for d, e in at.items()], "dir string, first long, seg int"))
        rows = rows.withColumn("dir", F.element_at(F.split(F.input_file_name(), "/"), -2))
        return rows.join(commits, "dir").select((F.col("first") + F.col("n")).alias("seq"), "seg", "t_ns", "batch_id", "op", "key", "value", "ttl_ns")

    def snapshot(self, version: dict | None = None) -> DataFrame:
        m = version or self._manifest()
        return self._read.schema(SNAPSHOT).parquet(f"{self.files.root}/snapshot/{m['snapshot']}") if m["snapshot"] else self.spark.createDataFrame([], SNAPSHOT)

    def history(self, version: dict | None = None) -> DataFrame:
        """Snapshot rows as puts before all else, and the operations after it."""
        m = version or self._manifest()
        base = self.snapshot(m).select(
            "seq", F.lit(-1).alias("seg"), F.lit(0).cast("long").alias("t_ns"), F.lit(0).cast("long").alias("batch_id"),
            F.when(F.col("expire_ns") > 0, PUT_TTL).otherwise(PUT).alias("op"), "key", "value", F.col("expire_ns").alias("ttl_ns"),
        )
        return base.unionByName(self.ops(m))

    def indexed(self, as_of_ns: int | None = None) -> DataFrame:
        """Keys with a value, expired ones too unless they have been purged."""
        self._check()
        m = self._manifest()
        return ttl.fold(self.history(m).where(F.col("t_ns") <= (self.clock() if as_of_ns is None else as_of_ns))).where(~expired(m["purged_ns"]))

    def live(self, as_of_ns: int | None = None) -> DataFrame:
        """(key, value, expire_ns, seq) of the live keys at a time, which is no earlier than the last compaction."""
        now = self.clock() if as_of_ns is None else as_of_ns
        return self.indexed(now).where(~expired(now))

    # Verbs: batches of one operation.

    def put(self, key: bytes | str, value: bytes | str | None) -> None:
        with self.batch() as b:
            b.put(key, value)

    def put_with_ttl(self, key: bytes | str, value: bytes | str | None, ttl_ns: int) -> None:
        with self.batch() as b:
            b.put_with_ttl(key, value, ttl_ns)

    def delete(self, key: bytes | str) -> None:
        with self.batch() as b:
            b.delete(key)

    def expire(self, key: bytes | str, ttl_ns: int) -> None:
        with self.batch() as b:
            b.expire(key, ttl_ns)

    def persist(self, key: bytes | str) -> None:
        with self.batch() as b:
            b.persist(key)

    def _row(self, key: bytes | str):
        raw = as_key(key)
        return self.live().where(F.col("key") == F.lit(raw)).first()

    def get(self, key: bytes | str) -> bytes:
        row = self._row(key)
        if row is None:
            raise KeyNotFound(key)
        return bytes(row.value) if row.value is not None else b""

    def exist(self, key: bytes | str) -> bool:
        return self._row(key) is not None

    def ttl(self, key: bytes | str) -> int:
        """Nanoseconds left, or -1 without expiry."""
        row = self._row(key)
        if row is None:
            raise KeyNotFound(key)
        return NO_TTL if row.expire_ns == 0 else row.expire_ns - self.clock()

    def get_many(self, keys: DataFrame) -> DataFrame:
        return lookup.get(self.live(), keys)

    def exist_many(self, keys: DataFrame) -> DataFrame:
        return lookup.exist(self.live(), keys)

    def ttl_many(self, keys: DataFrame) -> DataFrame:
        now = self.clock()
        return lookup.ttl(self.live(now), keys, now)

    def batch(self, options: BatchOptions | None = None) -> Batch:
        self._check()
        return Batch(self, options or BatchOptions())

    # Scans.

    def ascend(self) -> DataFrame:
        return scan.ascend(self.live()).select("key", "value")

    def ascend_range(self, start, end) -> DataFrame:
        return scan.ascend_range(self.live(), start, end).select("key", "value")

    def ascend_greater_or_equal(self, key) -> DataFrame:
        return scan.ascend_greater_or_equal(self.live(), key).select("key", "value")

    def descend(self) -> DataFrame:
        return scan.descend(self.live()).select("key", "value")

    def descend_range(self, start, end) -> DataFrame:
        return scan.descend_range(self.live(), start, end).select("key", "value")

    def descend_less_or_equal(self, key) -> DataFrame:
        return scan.descend_less_or_equal(self.live(), key).select("key", "value")

    def _keys(self, pattern: str | None, filter_expired: bool) -> DataFrame:
        check_pattern(self.spark, pattern)
        return self.live() if filter_expired else self.indexed()

    def ascend_keys(self, pattern: str | None = None, filter_expired: bool = False) -> DataFrame:
        return scan.ascend_keys(self._keys(pattern, filter_expired), pattern)

    def descend_keys(self, pattern: str | None = None, filter_expired: bool = False) -> DataFrame:
        return scan.descend_keys(self._keys(pattern, filter_expired), pattern)

    def ascend_keys_range(self, start, end, pattern: str | None = None, filter_expired: bool = False) -> DataFrame:
        return scan.ascend_keys_range(self._keys(pattern, filter_expired), start, end, pattern)

    def descend_keys_range(self, start, end, pattern: str | None = None, filter_expired: bool = False) -> DataFrame:
        return scan.descend_keys_range(self._keys(pattern, filter_expired), start, end, pattern)

    def iterator(self, options: IteratorOptions | None = None) -> scan.Cursor:
        """A cursor over the live rows of this moment; later commits do not show."""
        o = options or IteratorOptions()
        self._skip_corrupt = o.continue_on_error
        try:
            return scan.Cursor(self.live().select("key", "value"), o.prefix, o.reverse)
        finally:
            self._skip_corrupt = False

    def positions(self) -> DataFrame:
        """(key, seg, seq) of the indexed keys in key order: where the log holds the operation that a key's state comes from, segment -1 for the snapshot."""
        m = self._manifest()
        places = self.history(m).select("seq", "seg")
        return self.indexed().select("key", "seq").join(places, "seq").select("key", "seg", "seq").orderBy("key")

    # Maintenance.

    def merge(self) -> int:
        """Compact: write the live rows as a new snapshot, dealt and sorted by key, and drop the operations it holds. Returns its rows.

        Commits that come meanwhile stay in the log. Old files stay for readers of old versions until ``vacuum``.
        """
        self._check()
        if self.merging:
            raise MergeRunning("a compaction is under way")
        self.merging = True
        try:
            m, now, name = self._manifest(), self.clock(), uuid.uuid4().hex
            rows = ttl.fold(self.history(m)).where(~expired(now))
            n = self.options.shuffle_partitions
            dealt = rows.repartitionByRange(n, "key") if n else rows.repartitionByRange("key")
            dealt.sortWithinPartitions("key").write.parquet(f"{self.files.root}/snapshot/{name}")
            held = {e["dir"] for e in m["log"]}

            def adopt(x: dict) -> dict:
                if x["snapshot"] != m["snapshot"]:
                    raise MergeRunning("another compaction was published first")
                return x | {"snapshot": name, "log": [e for e in x["log"] if e["dir"] not in held], "seg": x["seg"] + 1, "seg_rows": 0, "seg_bytes": 0}

            self._publish(adopt)
            return self.spark.read.parquet(f"{self.files.root}/snapshot/{name}").count()
        finally:
            self.merging = False

    def vacuum(self) -> None:
        """Delete folders that the present version does not use, and all older manifests."""
        m = self._manifest()
        used = {"log": {e["dir"] for e in m["log"]}, "snapshot": {m["snapshot"]}}
        for kind, names in used.items():
            for name in set(self.files.list(kind)) - names:
                self.files.delete(f"{kind}/{name}")
        for name in self._versions():
            if name < _name(m["version"]):
                self.files.delete(f"manifest/{name}")

    def delete_expired_keys(self) -> int:
        """Purge: from now on expired keys do not count as indexed. One pass over metadata; returns how many there were."""
        now = self.clock()
        n = self.indexed(now).where(expired(now)).count()
        self._publish(lambda m: m | {"purged_ns": max(m["purged_ns"], now)})
        return n

    def stat(self) -> dict[str, int]:
        """keys_num (indexed keys) and disk_size (bytes of the files of this version)."""
        m = self._manifest()
        size = sum(self.files.size(f"log/{e['dir']}") for e in m["log"]) + (self.files.size(f"snapshot/{m['snapshot']}") if m["snapshot"] else 0)
        return {"keys_num": self.indexed().count(), "disk_size": size}

    def garbage(self) -> DataFrame:
        """(seg, records, live) of the operations since the snapshot."""
        keep = ttl.fold(self.history()).where(~expired(self.clock())).select("seq")
        ops = self.ops()
        return ops.join(keep.withColumn("keep", F.lit(1)), "seq", "left").groupBy("seg").agg(F.count("*").alias("records"), F.count("keep").alias("live"))

    # Change feed.

    def events(self, bounded: bool = False) -> DataFrame:
        """Events of the operations since the snapshot that took effect; ``bounded`` keeps what a ring of the options' size holds."""
        if not self.options.watch_queue_size:
            raise WatchDisabled("the watch queue's size is 0")
        done = ttl.annotate(self.history()).where("applied and seg >= 0")
        gone = F.col("op") == DELETE
        rows = done.select(F.when(gone, ACTION_DELETE).otherwise(ACTION_PUT).cast("byte").alias("action"), "key", F.when(~gone, F.col("base_value")).alias("value"), "batch_id", "seq")
        return feed.bounded(rows, self.options.watch_queue_size) if bounded else rows

    def watch(self) -> DataFrame:
        """A streaming DataFrame of committed operations, one row each as it arrives: action, op, key, value, batch_id.

        Expires and persists carry the value that their key had when they were staged.
        """
        if not self.options.watch_queue_size:
            raise WatchDisabled("the watch queue's size is 0")
        from .streaming.feed import watch

        return watch(self.spark, self.files.root)

    def pump(self, handler: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
        """Pass the feed to ``handler`` batch by batch until the store is closed; without an interval, only what is there now."""
        writer = self.watch().writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
        query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        self._queries.append(query)
        return query


class Batch:
    """Operations that are staged on the driver and committed together; of operations on one key, the last counts.

    ``expire`` and ``persist`` look at the staged operations first, then at the store.
    """

    def __init__(self, store: Store, options: BatchOptions):
        self.store, self.options = store, options
        self.staged: dict[bytes, tuple[str, bytes | None, int]] = {}
        self.state: type[Exception] | None = None

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()

    def _check(self, key: bytes | str, write: bool = True) -> bytes:
        raw = as_key(key)
        self.store._check()
        if self.state:
            raise self.state("the batch is over")
        if write and self.options.read_only:
            raise ReadOnlyBatch("the batch is read-only")
        return raw

    def put(self, key, value) -> None:
        self.staged[self._check(key)] = (PUT, _raw(value), 0)

    def put_with_ttl(self, key, value, ttl_ns: int) -> None:
        self.staged[self._check(key)] = (PUT_TTL, _raw(value), ttl_ns)

    def delete(self, key) -> None:
        self.staged[self._check(key)] = (DELETE, None, 0)

    def _change(self, key, op: str, ttl_ns: int) -> None:
        raw = self._check(key)
        if raw in self.staged:
            kind, value, _ = self.staged[raw]
            if kind == DELETE:
                raise KeyNotFound(key)
            if kind in (PUT, PUT_TTL):
                self.staged[raw] = (PUT_TTL, value, ttl_ns) if op == EXPIRE else (PUT, value, 0)
                return
        else:
            row = self.store._row(raw)
            if row is None:
                raise KeyNotFound(key)
            if op == PERSIST and row.expire_ns == 0 and raw not in self.staged:
                return  # nothing to clear, so nothing to write
            value = None if row.value is None else bytes(row.value)
        self.staged[raw] = (op, value, ttl_ns)

    def expire(self, key, ttl_ns: int) -> None:
        self._change(key, EXPIRE, ttl_ns)

    def persist(self, key) -> None:
        self._change(key, PERSIST, 0)

    def get(self, key) -> bytes:
        raw = self._check(key, write=False)
        if raw in self.staged and self.staged[raw][0] in (PUT, PUT_TTL, DELETE):
            kind, value, left = self.staged[raw]
            if kind == DELETE or kind == PUT_TTL and left <= 0:
                raise KeyNotFound(key)
            return value or b""
        return self.store.get(raw)

    def exist(self, key) -> bool:
        try:
            self.get(key)
        except KeyNotFound:
            return False
        return True

    def ttl(self, key) -> int:
        """As the store's, from what is staged first; a key whose deletion is staged has -1."""
        raw = self._check(key, write=False)
        if raw in self.staged:
            kind, _, left = self.staged[raw]
            return left if kind in (PUT_TTL, EXPIRE) else NO_TTL
        return self.store.ttl(raw)

    def commit(self) -> int | None:
        """Publish all staged operations at once; returns the batch's id, None if there were none."""
        if self.state:
            raise self.state("the batch is over")
        self.store._check()
        self.state = BatchCommitted
        if not self.staged or self.options.read_only:
            return None
        rows: Iterable = [(op, bytearray(key), None if value is None else bytearray(value), left, n) for n, (key, (op, value, left)) in enumerate(self.staged.items())]
        return self.store._commit(self.store.spark.createDataFrame(rows, "op string, key binary, value binary, ttl_ns long, n long").coalesce(1))

    def rollback(self) -> None:
        if self.state:
            raise self.state("the batch is over")
        self.state = BatchRollbacked
        self.staged.clear()


def _name(version: int) -> str:
    return f"v{version:016d}.json"


def _raw(value: bytes | str | None) -> bytes:
    return b"" if value is None else value.encode() if isinstance(value, str) else bytes(value)


__all__ = ["OPS", "Batch", "Files", "Store", "compact"]
