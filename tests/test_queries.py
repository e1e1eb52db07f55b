"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from cladewise.frames import TABLES
from cladewise.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _rows(frame) -> list[tuple]:
    names = sorted(frame.columns)

    def cell(v):
        if pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 8) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(([cell(v) for v in row] for row in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
