"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon import catalogue
from quillon.sources.catalog import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else glob.glob(path)[0]}'")
    return con


def normal(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return f"{value:.6g}"
    return str(int(value)) if isinstance(value, (int, np.integer)) else str(value)


def rows(df, columns):
    return sorted(tuple(normal(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_oracles_belong_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_top_k_plans_to_take_ordered(spark):
    df = catalogue.queries()["knn_prefilter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" in plan


def test_top_per_group_plans_to_group_limit(spark):
    df = catalogue.queries()["knn_top_per_group"](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
