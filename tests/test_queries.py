"""Every query of the catalogue runs; those with SQL agree with DuckDB on the same tables."""

import decimal
import os

import duckdb
import pytest

from leafwright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalogue.queries())


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = df.collect()
    if sql := catalogue.oracle_sql().get(name):
        want = db.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(df.columns, got) == _rows(want.columns, want.fetchall())
