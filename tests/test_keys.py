import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.config import Options
from stratalog.errors import InvalidOptions, InvalidPattern, KeyIsEmpty
from stratalog.functions.cron import check_cron
from stratalog.functions.generate import key_values
from stratalog.functions.keys import as_key, check_pattern, matches, prefix_successor, translate_pattern
from stratalog.sources.records import Record, RecordSource, decode, encode, read_segments, write_segment, write_segments


@given(st.binary(max_size=6), st.binary(max_size=8))
def test_prefix_range_holds_what_starts_with_it(prefix, key):
    upper = prefix_successor(prefix)
    assert key.startswith(prefix) == (key >= prefix and (upper is None or key < upper))


def test_prefix_of_all_ff_has_no_end():
    assert prefix_successor(b"\xff\xff") is None and prefix_successor(b"a\xff") == b"b" and prefix_successor(b"") is None


def test_empty_keys_are_refused():
    for key in (b"", ""):
        with pytest.raises(KeyIsEmpty):
            as_key(key)


@pytest.mark.parametrize("pattern,key,expected", [("e$", "date\n", False), ("e$", "date", True), ("(?m)e$", "date\nx", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("(?P<x>k)ey", "key", True), ("[]a]", "]", True), ("[[:digit:]]+x", "12x", True), ("", "anything", True), ("[a[]", "[", True)])
def test_patterns(spark, pattern, key, expected):
    df = spark.createDataFrame([(bytearray(key.encode()),)], "key binary")
    assert df.select(matches(F.col("key"), pattern)).first()[0] is expected


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "a++", "[a", "(?>a)", "a\\"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(InvalidPattern):
        translate_pattern(pattern)


def test_broken_patterns_are_errors(spark):
    with pytest.raises(InvalidPattern):
        check_pattern(spark, "(a")
    check_pattern(spark, None)


@pytest.mark.parametrize("text", ["* */1 * * * *", "*/1 * * * *", "5 0 * 8 *", "*/2 14 1 * *", "@hourly", "@every 1h30m", "0 9-17 * jan-mar mon"])
def test_schedules(text):
    check_cron(text)
    Options("x", auto_merge_cron=text)


@pytest.mark.parametrize("text", ["*/1 * * * * * *", "* * *", "61 * * * *", "@sometimes", "*/0 * * * *", "a * * * *", "5-1 * * * *"])
def test_bad_schedules(text):
    with pytest.raises(InvalidOptions):
        check_cron(text)


def test_options():
    for bad in ({"path": ""}, {"path": "x", "segment_rows": 0}, {"path": "x", "watch_queue_size": -1}):
        with pytest.raises(InvalidOptions):
            Options(**bad)


@given(st.integers(0, 2), st.integers(0, 2**63 - 1), st.binary(min_size=1, max_size=300), st.binary(max_size=300), st.integers(-(2**62), 2**62))
def test_records_round_trip(kind, batch, key, value, expire):
    r = Record(kind, batch, key, value, expire)
    assert decode(encode(r)) == r


def test_record_source(spark, tmp_path):
    write_segment(str(tmp_path / "0001"), [Record(0, 7, b"a", b"x"), Record(1, 7, b"b", b"")])
    write_segment(str(tmp_path / "0002"), [Record(2, 0, b"7", b"")])
    spark.dataSource.register(RecordSource)
    rows = spark.read.format("records").load(str(tmp_path)).orderBy("seq").collect()
    assert [(r.seg, r.record_type, r.batch_id, bytes(r.key), bytes(r.value)) for r in rows] == [(0, 0, 7, b"a", b"x"), (0, 1, 7, b"b", b""), (1, 2, 0, b"7", b"")]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_segments_written_by_tasks_come_back(spark, tmp_path, scheme):
    rows = [(seg, 10 * seg + i, i % 3, 5, f"k{i}".encode(), None if i == 1 else b"v" * i, i) for seg in range(4) for i in range(6)]
    log = spark.createDataFrame(rows, "seg int, seq long, record_type byte, batch_id long, key binary, value binary, expire_ns long").repartition(3)
    folder = f"{scheme}{tmp_path}/log"
    assert write_segments(log, folder) == 24
    got = [(r.seg, r.seq & 255, r.record_type, r.batch_id, bytes(r.key), bytes(r.value), r.expire_ns) for r in read_segments(spark, folder).orderBy("seq").collect()]
    assert got == [(seg, i, kind, batch, key, value or b"", expire) for (seg, _, kind, batch, key, value, expire), i in zip(rows, [i for _ in range(4) for i in range(6)], strict=True)]
    assert write_segments(log.limit(0), f"{scheme}{tmp_path}/none") == 0


def test_generated_rows(spark):
    rows = key_values(spark, 3, 128).orderBy("key").collect()
    assert [len(r.value) for r in rows] == [146] * 3 and re.fullmatch(rb".*-000000002", bytes(rows[2].key))
