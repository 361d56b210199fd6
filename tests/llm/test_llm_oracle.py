"""The queries that SQL can express against their DuckDB SQL, over whole tables."""

import duckdb
import pytest

from tableferry.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = duck.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(repr, expected.fetchall()))
