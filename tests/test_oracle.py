"""Every registered query against its DuckDB oracle, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload.fixtures import TABLES
from workload.jobs import JOBS as QUERIES
from workload.oracle import ORACLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    yield connection
    connection.close()


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert _normal([tuple(r) for r in result.collect()], result.columns) == _normal(expected.fetchall(), columns)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
