"""Every query with SQL against DuckDB, and every other query for a result."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tarnwood.plans import texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def told(frame, columns):
    def text(v):
        if v is None or v != v:
            return "-"
        return f"{float(v) + 0.0:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(texts.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = texts.QUERIES[name](spark, SF).toPandas(), duck.sql(texts.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert told(got, columns) == told(want, columns)


@pytest.mark.parametrize("name", sorted(set(texts.QUERIES) - set(texts.ORACLES)))
def test_has_rows(spark, name):
    assert texts.QUERIES[name](spark, SF).count() > 0
