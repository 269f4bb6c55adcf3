"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tarn import driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else repr(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, duck, name):
    found = driver.QUERIES[name](spark, SF)
    rows = plain(found.collect(), found.columns)
    if name in driver.ORACLES:
        expected = duck.sql(driver.ORACLES[name])
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows == plain(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert driver.entry(spark).count() == 60
