"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import catalog
from tools.oracle_check import TABLES, rows_of

# The queries of the llm folder are tested beside it.
QUERIES = {name: run for name, run in entry.queries().items() if name in catalog.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


#: A cheapest segmentation is beyond SQL; its tests are in test_segmentation.py.
WITHOUT_SQL = {"segment_words", "run_minhash_job_unspaced"}


def test_every_other_query_has_sql():
    assert set(SQL) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "turn", "text_1", "text_2"]
