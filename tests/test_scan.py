import pytest
from pyspark.sql import functions as F

from stratalog.operators import scan

FRUIT = ["apple", "banana", "cherry", "date", "grape", "kiwi"]


def rows(spark, keys, values=None):
    values = values or [f"value{i + 1}" for i in range(len(keys))]
    return spark.createDataFrame([(bytearray(k if isinstance(k, bytes) else k.encode()), bytearray(v.encode())) for k, v in zip(keys, values, strict=True)], "key binary, value binary")


def keys(df):
    return [bytes(r.key).decode("latin-1") for r in df.collect()]


@pytest.mark.parametrize("name,args,expected", [
    ("ascend", (), FRUIT), ("descend", (), FRUIT[::-1]), ("ascend_range", ("banana", "grape"), ["banana", "cherry", "date"]), ("descend_range", ("grape", "cherry"), ["grape", "date"]),
    ("ascend_greater_or_equal", ("date",), ["date", "grape", "kiwi"]), ("descend_less_or_equal", ("grape",), ["grape", "date", "cherry", "banana", "apple"]),
    ("ascend_keys_range", ("apple", "grape", ".*e$"), ["apple", "date"]), ("descend_keys_range", ("grape", "apple", ".*e$"), ["grape", "date"]), ("ascend_keys", (), FRUIT), ("descend_keys", ("^[a-c]",), ["cherry", "banana", "apple"]),
    ("ascend_range", ("banana", None), []), ("descend_range", ("banana", None), ["banana", "apple"]), ("descend_less_or_equal", (None,), []), ("ascend_greater_or_equal", (None,), FRUIT),
])
def test_ordered_scans(spark, name, args, expected):
    assert keys(getattr(scan, name)(rows(spark, FRUIT), *args)) == expected


def test_bytes_order_is_unsigned(spark):
    odd = [b"\xff", b"\x80", b"\x7f", b"a", b"\x00", b"\xff\xff"]
    df = rows(spark, odd)
    assert keys(scan.ascend(df)) == [k.decode("latin-1") for k in sorted(odd)]
    assert keys(scan.with_prefix(df, b"\xff")) == ["\xff", "\xff\xff"]


def test_range_mirror(spark):
    df = rows(spark, FRUIT)
    up = keys(scan.ascend_range(df, "banana", "grape"))
    down = keys(scan.descend_range(df, "date", "apple"))
    assert up == down[::-1]


def test_empty_table(spark):
    df = rows(spark, [], [])
    for f in (scan.ascend, scan.descend, scan.ascend_keys, scan.successors, scan.ranked):
        assert f(df).collect() == []
    assert not scan.Cursor(df).valid()
    assert scan.seek(df, spark.createDataFrame([(bytearray(b"a"),)], "probe binary")).first().key is None


@pytest.mark.parametrize("reverse", [False, True])
def test_seek_successors_and_ranks(spark, reverse):
    names = [f"k{i:03d}" for i in range(0, 300, 7)]
    df = rows(spark, names, names)
    probes = [f"k{i:03d}" for i in range(0, 310, 3)] + ["", "z"]
    got = {bytes(r.probe).decode(): r.key and bytes(r.key).decode() for r in scan.seek(df, spark.createDataFrame([(bytearray(p.encode()),) for p in probes], "probe binary"), reverse).collect()}
    for p in probes:
        fit = [k for k in names if (k <= p if reverse else k >= p)]
        assert got[p] == ((max if reverse else min)(fit) if fit else None)
    follow = {bytes(r.key).decode(): r.next_key and bytes(r.next_key).decode() for r in scan.successors(df).collect()}
    assert follow == dict(zip(names, [*names[1:], None], strict=True))
    order = sorted(names, reverse=reverse)
    assert {bytes(r.key).decode(): r.rn for r in scan.ranked(df, reverse).collect()} == {k: i + 1 for i, k in enumerate(order)}


def test_until_bytes_and_limits(spark):
    df = rows(spark, [f"k{i:02d}" for i in range(50)], ["x" * 10] * 50)
    assert keys(scan.until_bytes(df, 100)) == [f"k{i:02d}" for i in range(11)]
    assert keys(scan.ascend(df).limit(2)) == ["k00", "k01"]
    seen = []
    scan.run(scan.descend(df), lambda k, v: seen.append(k) or len(seen) < 2)
    assert seen == [b"k49", b"k48"]
    with pytest.raises(ZeroDivisionError):
        scan.run(df, lambda k, v: 1 / 0)


def test_cursor(spark):
    df = rows(spark, ["key1", "key2", "key3", "key4", "key5"])
    for reverse in (False, True):
        c = scan.Cursor(df, reverse=reverse)
        c.seek("key3")
        assert bytes(c.item().value) == b"value3"
        while c.valid():
            c.next()
        c.seek("key1")
        assert not c.valid() and c.item() is None
        c.rewind()
        assert c.valid() and c.err() is None
        c.close()
        assert not c.valid()
        c.next(), c.rewind(), c.seek("key1")
        assert c.item() is None
    c = scan.Cursor(rows(spark, ["a:1", "a:2", "b:1", "b:2", "c:1"]), prefix="b:")
    assert bytes(c.item().value) == b"value3"


@pytest.mark.parametrize("probe,expected", [("b", "bbcd"), ("cc", "code"), ("d", "eede"), ("f", None), ("aaa", "acee")])
def test_cursor_seek_table(spark, probe, expected):
    c = scan.Cursor(rows(spark, ["acee", "bbcd", "code", "eede"]))
    c.seek(probe)
    assert (bytes(c.item().key).decode() if c.valid() else None) == expected


def test_bounds_reach_the_files(spark, tmp_path):
    rows(spark, FRUIT).write.parquet(str(tmp_path / "t"))
    plan = scan.ascend_keys_range(spark.read.parquet(str(tmp_path / "t")), "b", "d")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "ReadSchema: struct<key:binary>" in plan
    assert spark.read.parquet(str(tmp_path / "t")).where(F.lit(True)).count() == 6


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("parts", [1, 3])
def test_rows_of_one_key_have_places_of_their_own(spark, reverse, parts):
    pairs = [("a", "2"), ("b", "9"), ("b", "1"), ("b", None), ("b", "5"), ("c", "0")]
    expected = [("a", "2"), ("b", None), ("b", "1"), ("b", "5"), ("b", "9"), ("c", "0")][:: -1 if reverse else 1]
    for given in (pairs, pairs[::-1], pairs[3:] + pairs[:3]):
        got = scan.ranked(spark.createDataFrame(given, "key string, value string").repartition(parts), reverse).collect()
        assert {(r.key, r.value): r.rn for r in got} == {k: i + 1 for i, k in enumerate(expected)}


def test_ranks_pass_over_columns_without_an_order(spark):
    df = spark.createDataFrame([("b", {"x": 1}, "2"), ("b", {"y": 2}, "1"), ("a", {}, "3")], "key string, m map<string, int>, value string")
    assert {r.value: r.rn for r in scan.ranked(df).collect()} == {"3": 1, "1": 2, "2": 3}
