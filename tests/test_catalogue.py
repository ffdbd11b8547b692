import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalog.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    sql = duck.sql(catalogue.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    assert plain(df.select(order).collect()) == plain(sql.select(*order).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["iter_prefix", "iter_prefix_reverse", "scan_asc_pages", "scan_desc_pages"])
def test_repeated_urls_stand_in_the_order_of_their_pages(spark, tmp_path, name):
    pages = [(i, f"{'https://blog' if i % 2 else 'http://'}.example.com/{i % 5}", f"page {i * 7 % 40:02d}") for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    # The SQL leaves the order of pages with one url open; closed by the page, it has one answer.
    sql = catalogue.ORACLES[name].replace("key ASC)", "key ASC, value ASC)").replace("key DESC)", "key DESC, value DESC)")
    assert "value ASC)" in sql or "value DESC)" in sql
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert plain(got.select("key", "value", "rn").collect()) == plain(con.sql(f"SELECT key, value, rn FROM ({sql})").fetchall())


@pytest.mark.parametrize("name", ["scan_asc_pages", "scan_desc_pages", "iter_prefix", "iter_prefix_reverse"])
def test_pages_without_url_stand_last(spark, tmp_path, name):
    pages = [(i, None if i == 7 else f"{'https://blog' if i % 2 else 'http://'}.example.com/{i}", None if i == 8 else f"page {i}") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert plain(got.select("key", "value", "rn").collect()) == plain(con.sql(f"SELECT key, value, rn FROM ({catalogue.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", ["iter_prefix_reverse", "scan_desc_pages"])
def test_odd_urls_that_do_not_tie_stand_as_in_the_sql(spark, tmp_path, name):
    urls = [None, "", "http:/", "http://", "http://\x00", "http://\x7f", "http://é", "http://\uffff", "http://\U00010000", "http:/0", "HTTP://a", " http://a", "\U0010ffff", *("http://" + "a" * n for n in (1, 64, 65, 5000))]
    pages = [(i, u, None if i % 5 == 0 else f"page {i}") for i, u in enumerate(urls)] + [(90 + i, "http://twice", "same") for i in range(2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert plain(got.select("key", "value", "rn").collect()) == plain(con.sql(f"SELECT key, value, rn FROM ({catalogue.ORACLES[name]})").fetchall())
