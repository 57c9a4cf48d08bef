"""Registered corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tiersift.llm import queries
from workload.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    text, ok = compare(spark, SF, name, queries.QUERIES[name], queries.ORACLES[name], connection)
    assert ok, text


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
