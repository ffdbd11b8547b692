import hashlib
import io

from stratalog.llm import warc
from stratalog.shared import fresh_path

SCHEMA = "page_id long, url string, html string, payload string"


def expected(rows):
    largest = {}
    for i, _, h, _ in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= 1000:
            largest[h] = max(largest.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        h = h or ""
        refers = largest.get(h) if i is not None and largest.get(h, i) != i else None
        out.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_archive_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/\r\n x%41", big, "x"), (2, None, big, "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", "short", "x"), (6, "u", "short", "x"), (None, "u", big, "x"), (7, "http://b/é", big + "z" * 900_000, "x"), (2, None, big, "x")]
    folder = fresh_path(spark, "t")
    index = warc.write_archive(warc.decide_revisits(spark.createDataFrame(rows, SCHEMA)), folder)
    read = warc.read_archive(spark, folder).collect()
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str)
    assert got == expected(rows)
    assert {r.id: r.url for r in read if r.id in (1, 7)} == {1: "http://a/\r\n x%41", 7: "http://b/é"}
    assert index.count() == len(rows)
    seen = {r.id: r for r in warc.read_records(spark, folder, spark.createDataFrame([(5,), (7,), (99,)], "i int")).collect()}
    assert set(seen) == {5, 7} and bytes(seen[7].payload) == rows[7][2].encode() and bytes(seen[5].payload) == b"short"


def test_frames_are_independent_and_seekable(spark):
    import zstandard
    from pyarrow import fs

    folder = fresh_path(spark, "t")
    rows = [(i, "u", f"{i} " + "abc " * 20_000, "x") for i in range(12)]
    index = warc.write_archive(warc.decide_revisits(spark.createDataFrame(rows, SCHEMA).coalesce(1)), folder).collect()
    store, path = fs.FileSystem.from_uri(warc._uri(spark, folder))
    assert max(r.frame for r in index) >= 1
    for r in index:
        with store.open_input_file(f"{path}/{r.bundle}") as f:
            table = warc.read_seek_table(f)
            start, size, full = table[r.frame]
            assert (start, size) == (r.frame_start, r.frame_bytes)
            f.seek(start)
            frame = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=full)
        (record,) = warc.parse_records(frame[r.record_start : r.record_start + r.record_bytes])
        assert record["id"] == r.id and record["payload"].startswith(f"{r.id} ".encode())


def test_repeated_ids_with_other_payloads_are_records_of_their_own(spark):
    rows = [(1, "u", "a" * 2000, "x"), (1, "u", "b" * 2000, "x"), (2, "u", "a" * 2000, "x"), (2, "u", "b" * 2000, "x")]
    folder = fresh_path(spark, "t")
    index = warc.write_archive(warc.decide_revisits(spark.createDataFrame(rows, SCHEMA)), folder).collect()
    assert len({r.record_id for r in index}) == 4
    read = warc.read_archive(spark, folder).collect()
    assert sorted((r.id, r.record_type, r.refers_to or 0) for r in read) == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0)]
    assert sorted(bytes(r.payload or b"")[:1] for r in warc.read_records(spark, folder, spark.createDataFrame([(1,), (2,), (2,)], "i int")).collect()) == [b"", b"", b"a", b"b"]


def test_a_task_a_bundle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1)
    rows = [(i, "u", f"{i} " * 1000, "x") for i in range(9)]
    folder = fresh_path(spark, "t")
    index = warc.write_archive(warc.decide_revisits(spark.createDataFrame(rows, SCHEMA)), folder)
    assert index.select("bundle").distinct().count() == 9
    read = warc.read_archive(spark, folder)
    assert read.rdd.getNumPartitions() == 9 and {r.id for r in read.collect()} == set(range(9))


def test_no_pages(spark):
    folder = fresh_path(spark, "t")
    warc.write_archive(warc.decide_revisits(spark.createDataFrame([], SCHEMA)), folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_seek_table_bytes():
    data = warc.seek_table([(3, 10), (5, 20)])
    assert warc.read_seek_table(io.BytesIO(b"abcdefgh" + data)) == [(0, 3, 10), (3, 5, 20)]
