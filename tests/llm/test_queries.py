import os

import duckdb
import pytest

from stratalog.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    sql = duck.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    want = duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in order)} FROM ({queries.ORACLES[name]})")
    assert plain(df.select([f"`{c}`" for c in order]).collect()) == plain(want.fetchall())


def test_queries_without_sql_return_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_pieces", "op3_quality", "pieces_viterbi"):
        assert queries.QUERIES[name](spark, SF).count() == n, name
