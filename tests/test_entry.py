"""The driver's entry on the smallest tables, against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quarry import registry
from quarry.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, bool) or str(type(v)).endswith("bool'>"):
            return bool(v)
        if isinstance(v, str):
            return v
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return round(float(v), 6)

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
