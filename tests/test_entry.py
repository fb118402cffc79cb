"""The driver's contract, over the smallest tables, against DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import oracle, project, queries

QUERIES, ORACLE_SQL = queries.QUERIES | project.QUERIES, oracle.ORACLE_SQL | project.ORACLE_SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shown(rows):
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(tuple(str(value(x)) for x in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = shown(df.select(cols).collect())
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        assert cols == sorted(con.sql(ORACLE_SQL[name]).columns)
        assert rows == shown(con.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall())
