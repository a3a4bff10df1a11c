"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def same(got, wanted):
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    mine, theirs = got.select(*columns).collect(), wanted.select(*columns).fetchall()
    assert sorted(map(str, map(tuple, mine))) == sorted(map(str, theirs))
    return len(mine)


def names():
    from quillgrid.llm.sql import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.parametrize("name", names())
def test_same_rows(spark, name):
    from quillgrid.llm.queries import queries
    from quillgrid.llm.sql import oracle_sql

    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert same(queries()[name](spark, DATA), con.sql(oracle_sql()[name].strip())) >= 200


@pytest.mark.parametrize("name", names())
def test_same_rows_of_odd_tables(spark, tmp_path, name):
    """Nulls, empty and odd texts, ties and repeated rows."""
    from quillgrid.llm.queries import queries
    from quillgrid.llm.sql import oracle_sql

    texts = [None, "", " ", "a", "MIT License, mit license\nthe Apache\x0blicense", "é é é é é é é é é é é é", "# x\n# x\n\n$ y", "a b c d e " * 4 + "\x1f \xa0", "General  Public\tLicense general public K license", "😀" * 9 + " ½ x"]
    data = [(i * 3 if i else None, t, ["s", None, "Z", "é"][i % 4], "en") for i, t in enumerate(texts)] + [(29, "same", "s", None), (29, "same", "s", None)]
    spark.createDataFrame(data, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(queries()[name](spark, str(tmp_path)), con.sql(oracle_sql()[name].strip())) == len(data)
