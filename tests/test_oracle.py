"""Every query with SQL gives the rows of that SQL; every other query runs and has rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.plans import catalog

QUERIES = catalog.load()
#: Differ from their SQL only on empty input or have nothing to find in the smallest tables.
MAY_BE_EMPTY = {"flt_01_search_filters", "win_18_size_cap", "rul_06_privacy_findings", "set_08_same_rows", "win_04_streaks", "join_19_contradictions"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(i) for i in x])
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def rows(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE_SQL:
        expected = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    if name not in MAY_BE_EMPTY:
        assert len(found) or name in catalog.ORACLE_SQL
