"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

from check import TABLES, same
from notewise.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert same(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
