"""The catalogue's queries against DuckDB on the same tables."""

import os

import duckdb
import pytest

from tessera import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_same_rows(spark, db, name):
    df = catalogue.queries()[name](spark, DIR)
    r = db.execute(catalogue.oracle_sql()[name])
    cols = sorted(x[0] for x in r.description)
    at = [[x[0] for x in r.description].index(c) for c in cols]
    assert sorted(df.columns) == cols
    assert sorted(str([row[c] for c in cols]) for row in df.collect()) == sorted(str([row[i] for i in at]) for row in r.fetchall())
