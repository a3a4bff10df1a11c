"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillgrid.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got, wanted = QUERIES[name](spark, DATA), duck.sql(ORACLES[name].strip())
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    mine, theirs = got.select(*columns).collect(), wanted.select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(str, map(tuple, mine))) == sorted(map(str, theirs))
    assert mine  # a query that finds nothing would agree with any that finds nothing
