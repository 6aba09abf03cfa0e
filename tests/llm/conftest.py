import duckdb
import pytest

from tools.oracle_check import TABLES


@pytest.fixture(scope="session")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def long_text():
    return "Lorem ipsum dolor sit amet, consectetur 4711 adipiscing. " * 4000
