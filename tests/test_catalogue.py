"""Every catalogued query against its SQL, on the driver's small tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    expected = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert rows == expected
