"""Every registered query of the engine against its DuckDB SQL over the whole tables of the smallest scale factor."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kryptonym.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
