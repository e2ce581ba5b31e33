import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


def test_queries_have_names_and_functions():
    assert set(SQL) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle_is_sql_that_duckdb_runs(db, name):
    assert isinstance(SQL[name], str)
    assert db.execute(SQL[name]).description
