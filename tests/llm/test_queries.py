"""Queries with SQL give its rows at the smallest scale; the others give one row for each input row or more."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        source = "pages" if name.startswith("op4") else "documents"
        assert len(got) >= con.sql(f"SELECT count(*) FROM {source}").fetchall()[0][0]
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)
