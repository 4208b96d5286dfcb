"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


def _plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if v is None or v is pd.NA or v != v:
        return "null"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def _rows(df):
    return sorted(tuple(_plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = db.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
