"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload.check import TABLES, compare, normal, rows_of
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"ml_score", "model_roundtrip", "triage_simple", "scan_eml"}


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, connection, name):
    text, ok = compare(spark, SF, name, contract.queries()[name], contract.oracle_sql().get(name), connection)
    assert ok, text


def test_entry_counts(spark):
    assert {r["label"]: r["n"] for r in contract.entry(spark).collect()} == {"BAD": 90, "UNKNOWN": 88, "GOOD": 22}


def test_rows_are_compared_by_column_name():
    assert rows_of(["b", "a"], [(1, 2)]) == [(normal(2), normal(1))]
