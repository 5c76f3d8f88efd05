"""Every query on the reference tables against its DuckDB counterpart, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from siltstone.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(_canon, v)) if isinstance(v, (list, tuple)) else v


def _rows(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), want.columns)
