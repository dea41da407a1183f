"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x + 0.0:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, db, name):
    df = catalogue.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, found.fetchall())
