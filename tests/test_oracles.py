"""Every registered layout query against DuckDB on the smallest tables, and those whose fixture changes with the scale on larger ones."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from sparklayout import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()
#: Hierarchies get more roots and levels, devices more cells, buses more bytes.
BY_SCALE = ("j7", "j8", "j9", "j10", "j11", "j12", "j14", "j15", "c5", "n5", "g8", "n1_", "t6")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for schema, folder in (("small", FOLDER), ("larger", LARGER)):
        con.execute(f"create schema {schema}")
        for path in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"create view {schema}.{os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    _compare(spark, duck, name, "small", FOLDER)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith(BY_SCALE)))
def test_query_equals_sql_on_larger_tables(spark, duck, name):
    _compare(spark, duck, name, "larger", LARGER)


def _compare(spark, duck, name, schema, folder):
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = [tuple(map(_plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    duck.execute(f"set schema='{schema}'")
    cursor = duck.execute(SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    want = [tuple(_plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert _sorted(got) == _sorted(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
