"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from trackplan import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    found = tables.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
