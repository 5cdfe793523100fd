"""Every query of the catalogue against its DuckDB SQL, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from pagewright.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].map(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, con, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(con.sql(ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
