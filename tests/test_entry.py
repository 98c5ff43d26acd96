"""The driver's contract: names, and columns equal to those of the SQL."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_every_sql_has_a_query_and_runs(con):
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        assert name in queries
        con.execute(sql).fetchall()


def plain(value):
    """A value as both engines have it: numbers to nine places of their size, times as text."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return str(value) if isinstance(value, (dt.date, dt.datetime)) else tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    names = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted(repr(plain(tuple(r[columns.index(c)] for c in names))) for r in cursor.fetchall())
    assert sorted(repr(plain(tuple(r))) for r in df.select(*names).collect()) == want


def test_sort_dataset_returns_the_whole_table_in_order(spark, con):
    got = entry.queries()["sort_dataset"](spark, D).collect()
    want = con.execute("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events").fetchall()
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted(want)
    assert [r["at"] for r in got] == sorted(r["at"] for r in got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
