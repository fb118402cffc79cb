"""Operators on inputs that the test tables lack, with the rows that are right."""

import cases
import duckdb
import pytest


def shown(rows):
    return sorted(tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, name):
    df = cases.QUERIES[name](spark, "")
    cols = sorted(df.columns)
    assert shown(df.select(cols).collect()) == shown(duckdb.sql(f"select {', '.join(cols)} from ({cases.ORACLE_SQL[name]})").fetchall())
