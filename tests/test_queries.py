"""Every query with SQL gives the same rows in DuckDB on the smallest tables; all others run."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from loamline.plans import queries as own
from loamline.plans import adapter_queries, history_queries, more_queries, text_queries

DATA = "/root/testdata/sf0.001"
QUERIES = {**own.QUERIES, **more_queries.QUERIES, **adapter_queries.QUERIES, **history_queries.QUERIES, **text_queries.QUERIES}
SQL = {**own.SQL, **more_queries.SQL, **adapter_queries.SQL, **history_queries.SQL, **text_queries.SQL}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "None" if pd.isna(v) else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    first = QUERIES[name](spark, DATA)
    assert first.columns
    assert rows(first.toPandas()) == rows(QUERIES[name](spark, DATA).toPandas())
