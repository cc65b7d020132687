"""Every registered query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from quernstone.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, tables, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in catalog.ORACLE:
        assert rows
        return
    got = tables.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert {c: TYPES[k] for c, k in df.dtypes} == {d[0]: str(d[1]) for d in got.description}
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())


def test_every_name_has_one_query():
    assert len(catalog.QUERIES) >= 60 and set(catalog.ORACLE) <= set(catalog.QUERIES)
