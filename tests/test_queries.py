"""Each driver query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from shellgraph import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def plain(v):
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 6)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in queries.ORACLE:
        assert rows
        return
    rel = duck.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == sorted(got.columns)
    assert table(rows, got.columns) == table(rel.fetchall(), list(rel.columns))


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.QUERIES) <= set(e.queries())
