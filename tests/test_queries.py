"""Every query against the same result in SQL, and what SQL cannot say against plain Python."""

import math

import duckdb
import pytest

from weftline.catalog import all_queries
from weftline.session import TABLES

TABLES_AT = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{TABLES_AT}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES_AT)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_every_query_runs(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, TABLES_AT).count() >= 0
