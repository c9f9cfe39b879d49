"""Queries of the operators that SQL can express, against their SQL on the driver's small tables."""

import os

import duckdb
import pytest

from tidemark.llm.entry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert rows == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
