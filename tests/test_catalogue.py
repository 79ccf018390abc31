"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(x) for x in value) + "]"
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, (float, np.floating)) and math.isnan(value)):
        return "-"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted("|".join(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_the_flagship_has_rows(spark):
    assert catalogue.FLAGSHIP(spark, SF).count() > 0
