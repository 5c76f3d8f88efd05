"""The queries that have DuckDB counterparts against these."""

import duckdb
import pytest

from siltstone.llm import registry

TABLES = ("documents", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_rows_equal_the_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
