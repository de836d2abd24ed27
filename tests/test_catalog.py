"""Every query of the catalogue against DuckDB over the same tables."""

import decimal
import os

import duckdb
import pytest

from shardloom.plans import catalog
from shardloom.session import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    rows, columns = df.collect(), df.columns
    if name not in catalog.oracle_sql():
        assert columns and rows
        return
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(columns) == sorted(names)
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(map(plain, r)) for r in rows))) == sorted(map(repr, want))


def test_flagship(spark, duck):
    assert catalog.flagship(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name, table", [("join_lateral_all", "customer"), ("scalar_subquery_all", "orders")])
def test_all_keys(spark, duck, name, table):
    [(want,)] = duck.execute(f"SELECT COUNT(*) FROM {table}").fetchall()
    assert catalog.queries()[name](spark, FOLDER).count() == want


def test_all_pairs(spark, duck):
    [(want,)] = duck.execute("SELECT (SELECT COUNT(*) FROM region) * (SELECT COUNT(*) FROM nation)").fetchall()
    assert catalog.queries()["join_cross_all"](spark, FOLDER).count() == want
