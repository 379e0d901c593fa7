"""Each query with SQL against it on sf0.001, in DuckDB."""

import os

import pytest

from seamwright.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = queries()[name](spark, DATA)
    found = con.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(df.columns)
    plain = lambda rows, names: sorted(str(sorted(zip(names, (round(v, 9) if isinstance(v, float) else v for v in r), strict=True))) for r in rows)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), found.columns)
