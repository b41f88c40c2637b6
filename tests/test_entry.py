"""The driver's contract: every query runs, and those with SQL agree with it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from brightwater.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = sorted([tuple(shown(r[c]) for c in sorted(found.columns)) for r in found.collect()], key=str)
    if name not in ORACLES:
        assert rows
        return
    expected = duck.sql(ORACLES[name])
    at = sorted(range(len(expected.columns)), key=lambda i: expected.columns[i])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows == sorted([tuple(shown(r[i]) for i in at) for r in expected.fetchall()], key=str)
