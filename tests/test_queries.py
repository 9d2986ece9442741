import datetime
import decimal
import os
import re

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and not re.match(r"op\d+_", n)])
def test_equals_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
