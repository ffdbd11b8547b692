import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import batch, compact, feed, log, lookup, ttl

LOG = "seq long, seg int, record_type int, batch_id long, key string, value string, expire_ns long"
OPS = "seq long, t_ns long, batch_id long, op string, key string, value string, ttl_ns long"


def logged(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("record_type", F.col("record_type").cast("byte"))


def test_torn_batches_and_batch_zero(spark):
    df = logged(spark, [
        (1, 0, 0, 5, "a", "1", 0), (2, 0, 2, 0, "5", None, 0), (3, 0, 0, 6, "a", "2", 0), (4, 0, 0, 0, "b", "3", 0), (5, 0, 1, 0, "b", None, 0), (6, 0, 0, 5, "c", "4", 0),
    ])
    assert sorted(r.seq for r in log.committed(df).collect()) == [1, 4]  # 6 reuses a number whose mark came before
    assert sorted(r.seq for r in log.torn(df).collect()) == [3, 6]
    assert sorted((r.key, r.value) for r in log.latest(log.committed(df)).collect()) == [("a", "1"), ("b", "3")]


def test_expiry_boundary_and_tombstones(spark):
    df = logged(spark, [(1, 0, 0, 0, "a", "", 100), (2, 0, 0, 0, "b", "x", 101), (3, 0, 0, 0, "c", "y", 0), (4, 0, 1, 0, "c", None, 0)])
    assert [r.key for r in log.live(df, 100).collect()] == ["b"]  # equal is expired
    assert sorted(r.key for r in log.live(df, 99).collect()) == ["a", "b"]  # an empty value lives
    assert sorted(r.key for r in log.latest(df).collect()) == ["a", "b"]


def model(ops, as_of):
    """One operation after the other."""
    state = {}
    for o in sorted(ops):
        seq, t, _, op, key, value, left = o
        held = state.get(key)
        if held and 0 < held[1] <= t:
            held = state.pop(key) and None
        if op == "put":
            state[key] = [value, 0, seq]
        elif op == "put_ttl":
            state[key] = [value, t + left, seq]
        elif op == "delete":
            state.pop(key, None)
        elif held:
            held[1], held[2] = (t + left if op == "expire" else 0), seq
    return {k: (v, e, s) for k, (v, e, s) in state.items() if not 0 < e <= as_of}


@pytest.mark.parametrize("seed", range(4))
def test_fold_against_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    ops = [(i, i * 10 + rng.randrange(10), i // 3, rng.choice(["put", "put_ttl", "delete", "expire", "persist"]), f"k{rng.randrange(12)}", f"v{i}", rng.randrange(-5, 150)) for i in range(400)]
    df = spark.createDataFrame(ops, OPS)
    for as_of in (4000, 4100, 2000):
        want = model([o for o in ops if o[1] <= as_of], as_of)
        got = {r.key: (r.value, r.expire_ns, r.seq) for r in ttl.state_as_of(df, as_of).collect()}
        assert got == want
    kept = [o for o in ops if o[2] % 4]
    got = {r.key for r in ttl.state_as_of(batch.without_batches(df, df.where("batch_id % 4 = 0")), 4100).collect()}
    assert got == set(model(kept, 4100))


def test_fold_uses_one_exchange(spark):
    df = spark.createDataFrame([(1, 1, 1, "put", "a", "x", 0)], OPS).repartition(3)
    plan = ttl.fold(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key") == 1 and "Python" not in plan


def test_statuses(spark):
    df = spark.createDataFrame([(1, 1, 1, "expire", "a", None, 5), (2, 2, 1, "put_ttl", "a", "x", 10), (3, 5, 1, "persist", "a", None, 0), (4, 6, 1, "expire", "a", None, 1), (5, 7, 1, "persist", "a", None, 0), (6, 8, 1, "delete", "z", None, 0)], OPS)
    assert [(r.seq, r.status) for r in ttl.statuses(df, "expire").orderBy("seq").collect()] == [(1, "not_found"), (4, "ok")]
    assert [(r.seq, r.status) for r in ttl.statuses(df, "persist").orderBy("seq").collect()] == [(3, "ok"), (5, "not_found")]
    assert [r.status for r in ttl.statuses(df, "delete").collect()] == ["ok"]


def test_lookups(spark):
    live = spark.createDataFrame([("a", "1", 0), ("b", "2", 150)], "key string, value string, expire_ns long")
    keys = spark.createDataFrame([("a",), ("b",), ("x",), ("a",)], "key string")
    assert sorted((r.key, r.value) for r in lookup.get(live, keys).collect()) == [("a", "1"), ("a", "1"), ("b", "2")]
    assert sorted((r.key, r.found) for r in lookup.exist(live, keys).collect()) == [("a", True), ("a", True), ("b", True), ("x", False)]
    assert sorted(map(tuple, lookup.ttl(live, keys.distinct(), 100).collect())) == [("a", -1, "ok"), ("b", 50, "ok"), ("x", -1, "not_found")]


def test_compaction_changes_no_later_state(spark):
    rng = random.Random(9)
    rows = [(i, i // 50, rng.choice([0, 0, 1]), 0, f"k{rng.randrange(30)}", f"v{i}", rng.choice([0, 0, 900])) for i in range(300)]
    rows = [(s, g, 0 if t == 0 else 1, 0, k, v, e) for s, g, t, _, k, v, e in rows]
    df = logged(spark, rows).withColumn("batch_id", F.lit(1).cast("long")).unionByName(logged(spark, [(10_000, 9, 2, 0, "1", None, 0)]))
    early = compact.merge_live(df, 2, 500)
    marks = df.where("record_type = 2")
    snapshot = compact.merge_live(df.where("seg <= 2").unionByName(marks), 9, 500)
    assert early.count() == 0 and snapshot.count() > 0  # the mark lies in a later segment
    both = log.override(snapshot, log.committed(df).where("seg > 2"))
    assert sorted(map(tuple, both.select("key", "value", "seq").collect())) == sorted(map(tuple, log.latest(log.committed(df)).select("key", "value", "seq").collect()))
    per = {r.seg: (r.records, r.live, r.garbage) for r in compact.garbage_by_segment(df, 500).collect()}
    assert sum(x[1] for x in per.values()) == log.live(log.committed(df), 500).count() and all(a == b + c for a, b, c in per.values())
    assert compact.stat(df).first().keys_num == log.latest(log.committed(df)).count()
    assert compact.purge(log.latest(log.committed(df)), 900).count() == log.live(log.committed(df), 900).count()


def test_feed(spark):
    df = logged(spark, [(2 * i, 0, int(i % 5 == 0), 1 + i // 10, f"k{i}", None if i % 5 == 0 else "v", 0) for i in range(2500)]).unionByName(logged(spark, [(20 * b - 1, 0, 2, 0, str(b), None, 0) for b in range(1, 251)]))
    events = feed.events(df)
    assert events.count() == 2500
    for capacity, size in ((1000, 998), (1, 0), (2, 0), (3, 1)):
        got = [r.seq for r in feed.bounded(events, capacity).collect()]
        assert got == [2 * i for i in range(2499, 2499 - size, -1)]
    assert {(r.n_puts, r.n_deletes) for r in feed.batch_summary(events).collect()} == {(8, 2)}
    one = events.where("seq = 0").first()
    assert (one.action, one.value) == (1, None)
