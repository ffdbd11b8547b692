import pytest
from pyspark.sql import functions as F

from stratalog.config import BatchOptions, IteratorOptions, Options
from stratalog.errors import BatchCommitted, BatchRollbacked, DBClosed, InvalidPattern, KeyIsEmpty, KeyNotFound, MergeRunning, ReadOnlyBatch, WatchDisabled
from stratalog.functions.cron import next_time
from stratalog.table import Store

MS = 1_000_000


@pytest.fixture
def store(spark, tmp_path, clock):
    return Store.open(spark, Options(str(tmp_path / "db"), watch_queue_size=1000), clock)


def reopen(store):
    store.close()
    return Store.open(store.spark, store.options, store.clock)


def keys(df):
    return [bytes(r.key).decode() for r in df.collect()]


def test_put_get_delete_reopen(store):
    store.put("a", "1")
    store.put("a", "2")
    store.put("empty", "")
    store.delete("absent")
    assert store.get("a") == b"2" and store.get("empty") == b"" and not store.exist("absent")
    store.delete("a")
    with pytest.raises(KeyNotFound):
        store.get("a")
    again = reopen(store)
    assert keys(again.ascend()) == ["empty"] and again.stat()["keys_num"] == 1 and again.stat()["disk_size"] > 0
    with pytest.raises(DBClosed):
        store.put("x", "y")


def test_ttl_expire_persist(store, clock):
    store.put_with_ttl("1", "x", 100 * MS)
    store.put_with_ttl("2", "y", 200 * MS)
    store.put("2", "z")
    store.put_with_ttl("3", "w", 1000 * MS)
    store.persist("3")
    store.put("4", "v")
    store.expire("4", 100_000 * MS)
    assert store.exist("1") and store.ttl("1") == 100 * MS
    clock.pass_ms(200)
    assert not store.exist("1") and store.get("2") == b"z" and store.ttl("3") == -1
    with pytest.raises(KeyNotFound):
        store.expire("1", 5)
    with pytest.raises(KeyNotFound):
        store.persist("nobody")
    clock.pass_ms(2000)
    again = reopen(store)
    assert again.get("3") == b"w" and again.ttl("4") > 90_000 * MS


def test_batches(store):
    with store.batch() as b:
        b.put("k", "1")
        b.put("k", "2")
        assert b.get("k") == b"2"
        b.put("gone", "x")
        b.delete("gone")
        assert not b.exist("gone") and b.ttl("gone") == -1
        for f in (lambda: b.expire("gone", 5), lambda: b.persist("gone")):
            with pytest.raises(KeyNotFound):
                f()
        assert not store.exist("k")
    assert store.get("k") == b"2" and not store.exist("gone")
    with pytest.raises(BatchCommitted):
        b.put("k", "3")
    with pytest.raises(BatchCommitted):
        b.commit()
    r = store.batch()
    r.put("r", "1")
    r.rollback()
    assert not store.exist("r")
    with pytest.raises(BatchRollbacked):
        r.commit()
    ro = store.batch(BatchOptions(read_only=True))
    assert ro.get("k") == b"2"
    for f in (lambda: ro.put("k", "x"), lambda: ro.expire("k", 1), lambda: ro.persist("k"), lambda: ro.delete("k")):
        with pytest.raises(ReadOnlyBatch):
            f()


def test_empty_keys(store):
    for f in (lambda: store.put("", "x"), lambda: store.get(""), lambda: store.delete(""), lambda: store.exist(""), lambda: store.ttl(""), lambda: store.expire("", 1), lambda: store.persist(b"")):
        with pytest.raises(KeyIsEmpty):
            f()
    with pytest.raises(KeyIsEmpty):
        store.write(store.spark.createDataFrame([("put", "", "x")], "op string, key string, value string"))


def test_scans_with_expiry_and_patterns(store, clock):
    rows = [("put", k, "v", 0) for k in ("apple", "banana", "date", "grape")] + [("put_ttl", "cherry", "v", 100 * MS)]
    store.write(store.spark.createDataFrame(rows, "op string, key string, value string, ttl_ns long"))
    assert keys(store.ascend_keys_range("banana", "grape")) == ["banana", "cherry", "date"]
    assert keys(store.ascend_keys_range("apple", "grape", ".*e$")) == ["apple", "date"]
    clock.pass_ms(200)
    assert keys(store.ascend_keys_range("banana", "grape", filter_expired=True)) == ["banana", "date"]
    assert keys(store.descend_keys_range("grape", "banana")) == ["grape", "date", "cherry"]
    assert keys(store.descend_keys_range("grape", "banana", filter_expired=True)) == ["grape", "date"]
    with pytest.raises(InvalidPattern):
        store.ascend_keys("(a")
    it = store.iterator(IteratorOptions(prefix=b"d", reverse=True))
    assert bytes(it.item().key) == b"date"
    assert store.stat()["keys_num"] == 5 and store.delete_expired_keys() == 1 and store.stat()["keys_num"] == 4


def test_merge_keeps_state_and_drops_garbage(store, clock):
    spark = store.spark
    for op, low, high in (("put", 0, 1000), ("put", 0, 1000), ("put", 1000, 3000), ("delete", 1000, 2000)):
        store.write(spark.range(low, high).select(F.lit(op).alias("op"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("key"), F.when(F.lit(op) == "put", "v").alias("value")))
    store.put_with_ttl("short", "x", 10 * MS)
    clock.pass_ms(20)
    before = sorted(map(str, store.live().select("key", "value").collect()))
    assert store.garbage().agg(F.sum("records"), F.sum("live")).first() == (5001, 2000)
    assert store.merge() == 2000
    store.vacuum()
    assert sorted(map(str, store.live().select("key", "value").collect())) == before
    store.put("k000000001", "new")
    store.delete("k000000000")
    assert store.get("k000000001") == b"new" and reopen(store).stat()["keys_num"] == 1999
    assert len(store.files.list("log")) == 2
    store.closed = False
    assert store.merge() == 1999 and store.merge() == 1999
    store.merging = True
    with pytest.raises(MergeRunning):
        store.merge()


def test_commits_are_atomic(store):
    store.put("a", "1")
    store._settle = lambda name: None  # the writer dies between publishing and moving
    store.put("b", "2")
    assert keys(store.ascend()) == ["a", "b"]
    again = Store.open(store.spark, store.options, store.clock)
    assert keys(again.ascend()) == ["a", "b"] and again.files.list("staging") == []
    store.spark.createDataFrame([("put", b"c", b"3", 0, 0)], "op string, key binary, value binary, ttl_ns long, n long").write.parquet(f"{store.files.root}/staging/torn")
    assert keys(Store.open(store.spark, store.options, store.clock).ascend()) == ["a", "b"]


def test_last_operation_of_a_written_batch_counts(store):
    store.write(store.spark.createDataFrame([("put", "a", "1", 1), ("delete", "a", None, 2), ("put", "b", "1", 2), ("put", "b", "2", 3)], "op string, key string, value string, i int"), order="i")
    assert [(bytes(r.key), bytes(r.value)) for r in store.ascend().collect()] == [(b"b", b"2")]


def test_bulk_reads(store, clock):
    store.put("a", "1")
    store.put_with_ttl("b", "2", 5 * MS)
    probes = store.spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"c"),)], "key binary")
    assert store.get_many(probes).count() == 2
    assert {bytes(r.key): r.found for r in store.exist_many(probes).collect()} == {b"a": True, b"b": True, b"c": False}
    assert {bytes(r.key): (r.ttl_ns, r.status) for r in store.ttl_many(probes).collect()} == {b"a": (-1, "ok"), b"b": (5 * MS, "ok"), b"c": (-1, "not_found")}


def test_events(store):
    store.put("a", "1")
    store.delete("a")
    store.put("b", "2")
    store.persist("b")  # has no expiry, so nothing is written
    store.expire("b", 1_000_000 * MS)
    got = [(r.action, bytes(r.key), r.value and bytes(r.value)) for r in store.events().orderBy("seq").collect()]
    assert got == [(0, b"a", b"1"), (1, b"a", None), (0, b"b", b"2"), (0, b"b", b"2")]
    with pytest.raises(WatchDisabled):
        Store.open(store.spark, store.options.path, store.clock).watch()
    rows = []
    q = store.watch().writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", store.options.path + "-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.action, bytes(r.key)) for r in rows) == [(0, b"a"), (0, b"b"), (0, b"b"), (1, b"a")]
    assert {(r.op, bytes(r.key)): r.value and bytes(r.value) for r in rows} == {("put", b"a"): b"1", ("delete", b"a"): None, ("put", b"b"): b"2", ("expire", b"b"): b"2"}


def test_streamed_values_of_bulk_expires(store):
    spark = store.spark
    store.write(spark.createDataFrame([("put", "a", "1"), ("put", "b", "2")], "op string, key string, value string"))
    store.write(spark.createDataFrame([("expire", "a", None, 10**15), ("persist", "c", None, 0)], "op string, key string, value string, ttl_ns long"))
    assert {(r.op, bytes(r.key)): r.value and bytes(r.value) for r in store.ops().collect()}[("expire", b"a")] == b"1"
    assert store.get("a") == b"1" and not store.exist("c")


def test_a_torn_manifest_does_not_count(store):
    store.put("a", "1")
    store.put("b", "2")
    name = f"{store.options.path}/manifest/{store._versions()[-1]}"
    with open(name) as f:
        whole = f.read()
    with open(name, "w") as f:
        f.write(whole[: len(whole) // 2])
    again = Store.open(store.spark, store.options, store.clock)
    assert keys(again.ascend()) == ["a"]
    again.put("c", "3")
    assert keys(again.ascend()) == ["a", "c"] and len(again._versions()) == 4
    again.vacuum()
    assert keys(Store.open(store.spark, store.options, store.clock).ascend()) == ["a", "c"]


def test_only_one_writer_gets_a_name(store):
    assert store.files.create("manifest/x.json", "{}") and not store.files.create("manifest/x.json", "[]")
    assert store.files.read("manifest/x.json") == "{}" and not [n for n in store.files.list("manifest") if n.startswith(".")]


def test_a_compaction_of_an_old_version_is_not_published(store):
    store.put("a", "1")
    other = Store.open(store.spark, store.options, store.clock)
    published = store._publish

    def late(change):
        other.put("b", "2")
        other.merge()
        return published(change)

    store._publish = late
    with pytest.raises(MergeRunning):
        store.merge()
    assert keys(other.ascend()) == ["a", "b"]


def test_segments_end_by_bytes_and_are_read_alone(store):
    small = Store.open(store.spark, Options(store.options.path, segment_bytes=1), store.clock)
    for k in "abc":
        small.put(k, k)
    assert {(bytes(r.key), r.seg) for r in small.ops().collect()} == {(b"a", 0), (b"b", 1), (b"c", 2)}
    bounded = small.ops(after=0, up_to=1)
    assert [bytes(r.key) for r in bounded.collect()] == [b"b"] and len(bounded.inputFiles()) == 1
    assert small.ops(after=5).count() == 0
    assert [(bytes(r.key), r.seg) for r in small.positions().collect()] == [(b"a", 0), (b"b", 1), (b"c", 2)]


def test_the_pump_runs_until_the_store_is_closed(store):
    import time

    rows = []
    q = store.pump(lambda df, _: rows.extend(df.collect()), store.options.path + "-cp", "200 milliseconds")
    store.put("a", "1")
    for _ in range(150):
        if rows:
            break
        time.sleep(0.1)
    store.close()
    assert [bytes(r.key) for r in rows] == [b"a"] and not q.isActive


def test_a_store_compacts_itself_in_time(spark, tmp_path):
    import time

    store = Store.open(spark, Options(str(tmp_path / "db"), auto_merge_cron="@every 1s"))
    store.put("a", "1")
    for _ in range(300):
        if store._manifest()["snapshot"] and not store._manifest()["log"]:
            break
        time.sleep(0.1)
    assert store._manifest()["snapshot"] and keys(store.ascend()) == ["a"]
    store.close()
    assert not store._merger.is_alive()


def test_times_of_schedules():
    from datetime import datetime, timezone

    def after(expression, *at):
        return datetime.fromtimestamp(next_time(expression, int(datetime(*at, tzinfo=timezone.utc).timestamp()) * 10**9) / 1e9, timezone.utc).replace(tzinfo=None)

    assert after("*/15 * * * *", 2024, 1, 1, 10, 14, 59) == datetime(2024, 1, 1, 10, 15)
    assert after("0 0 * * *", 2024, 2, 28, 0, 0, 0) == datetime(2024, 2, 29)
    assert after("30 10 2-4/2 mar mon", 2024, 3, 1) == datetime(2024, 3, 2, 10, 30)
    assert after("5 0 0 1 1 *", 2024, 1, 1, 0, 0, 5) == datetime(2025, 1, 1, 0, 0, 5)
    assert after("@weekly", 2024, 5, 1) == datetime(2024, 5, 5)
    assert after("TZ=Asia/Tokyo 0 9 * * *", 2024, 5, 1, 1) == datetime(2024, 5, 2)
    assert next_time("@every 1m30s", 7) == 90 * 10**9 + 7
    assert next_time("0 0 31 2 *", 0) is None
