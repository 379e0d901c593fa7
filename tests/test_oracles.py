"""Each registered query against its SQL on sf0.001, in DuckDB."""

import os

import pytest

from seamwright.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(found.fetchall(), found.columns)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rename_pairs_use_each_field_once(spark):
    rows = QUERIES["f7_renames"](spark, DATA).collect()
    assert len({(r.contract_id, r.old_path) for r in rows}) == len(rows) == len({(r.contract_id, r.new_path) for r in rows})
