"""Ranks and first rows over keys that many tasks share, against DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import catalogue
from quillon.operators import ranks
from quillon.sources.catalog import TABLES

SF = "/root/testdata/sf0.001"
SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def orders(many_peers):
    """One status with nearly all rows, null, short and single ones, equal and null prices and priorities."""
    rng = random.Random(3)
    statuses = ["F"] * 1800 + [None] * 7 + ["O"] * 3 + ["P"]
    rng.shuffle(statuses)
    peers = [f"p{i}" for i in range(1500)] if many_peers else ["1-URGENT", "5-LOW", "", None]
    prices = [0.0, -0.0, 1.5, 2.5, float("nan"), None]
    return [(i, 1, s, rng.choice(prices), None, rng.choice(peers)) for i, s in enumerate(statuses)]


@pytest.mark.parametrize("many_peers", [False, True])
def test_win_ranks_holds_no_status_in_a_task(spark, tmp_path, monkeypatch, many_peers):
    spark.createDataFrame(orders(many_peers), SCHEMA).write.parquet(f"{tmp_path}/orders.parquet")
    for t in set(TABLES) - {"orders"}:
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    monkeypatch.setattr(ranks, "ROWS", 100, raising=False)
    kept, write = [], getattr(ranks, "written", None)
    monkeypatch.setattr(ranks, "written", lambda df: kept.append(write(df)) or kept[-1], raising=False)
    ours = catalogue.queries()["win_ranks"](spark, str(tmp_path))
    got = sorted(map(tuple, ours.collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.oracle_sql()["win_ranks"]).fetchall())
    assert [(n, t) for n, t in ours.dtypes] == [("o_orderkey", "bigint"), *[(c, "int") for c in ("rn", "rk", "dr")], ("pr", "double"), ("cd", "double"), ("q", "int")]
    sorted_rows = next(df for df in kept if {"o_orderkey", "__at"} <= set(df.columns))
    sizes = [r["count"] for r in sorted_rows.groupBy(F.shiftright("__at", 33).alias("p")).count().collect()]
    assert sum(sizes) == 1811 and len(sizes) > 12 and max(sizes) < 400
    assert "Window" not in ours._jdf.queryExecution().executedPlan().toString()


def test_win_ranks_of_no_orders(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/orders.parquet")
    assert catalogue.queries()["win_ranks"](spark, str(tmp_path)).count() == 0


def test_metric_scores_sort_no_nation(spark, tmp_path):
    rng, segments = random.Random(5), ["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD"]
    rows = [(i, f"c{i}", i % 25, rng.choice([0.0, -0.0, 2.5, -1.5, float("nan"), None]), rng.choice(segments)) for i in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("supplier", "nation"):
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    ours = catalogue.queries()["metric_scores"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    for t in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(catalogue.oracle_sql()["metric_scores"])
    names = [d[0] for d in theirs.description]
    flat = lambda rows: [pytest.approx(r) for r in sorted(rows)]
    assert sorted(map(tuple, ours.select(names).collect())) == flat(theirs.fetchall())
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "c_acctbal" in line]
