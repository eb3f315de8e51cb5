"""Search as a table function, against sorting all rows; keyed streaming state, stopped and started again."""

import datetime
import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillon.operators import search_function
from quillon.streaming import state


@pytest.fixture(scope="module")
def named(spark):
    search_function.register(spark)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 4, 3).astype(float).tolist(), f"n{i % 7}") for i in range(300)]  # small integers: many ties
    rows += [(None, [1.0, 1.0, 1.0], "no key"), (900, None, "null"), (901, [1.0], "short"), (902, [1.0, None, 2.0], "hole"), (903, [float("nan"), 0.0, 0.0], "nan"), (904, [], "empty")]
    spark.createDataFrame(rows, "id long, v array<double>, name string").repartition(5).createOrReplaceTempView("named_vectors")
    return rows


def brute(rows, q, k, measure):
    kept = [(measure(np.array(v), np.array(q)), i is not None, i or 0, i) for i, v, _ in rows if v and len(v) == len(q) and None not in v and not np.isnan(v).any()]
    return [(i, round(d, 9)) for d, _, _, i in sorted(kept)[:k]]


@pytest.mark.parametrize("metric,measure", [("l2", lambda a, b: float(np.linalg.norm(a - b))), ("ip", lambda a, b: -float(a @ b))])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_nearest_equals_sorting(spark, named, metric, measure, k):
    q = [1.0, 2.0, 0.0]
    sql = f"SELECT id, distance FROM nearest(TABLE(named_vectors), 'v', array(1.0D, 2.0D, 0.0D), {k}, 'id', '{metric}') ORDER BY distance, id LIMIT {k}"
    assert [(r["id"], round(r["distance"], 9)) for r in spark.sql(sql).collect()] == brute(named, q, k, measure)
    frame = search_function.nearest_rows(spark.table("named_vectors"), "v", q, k, "id", metric)
    assert [r["id"] for r in frame.collect()] == [i for i, _ in brute(named, q, k, measure)]
    assert frame.columns == ["id", "v", "name", "distance"]


def test_nearest_over_subqueries_empty_tables_and_null_queries(spark, named):
    inner = "SELECT id, v FROM named_vectors WHERE name = 'n3'"
    got = spark.sql(f"SELECT id FROM nearest(TABLE({inner}), 'v', array(1, 2, 0), 4, 'id') ORDER BY distance, id LIMIT 4")
    only = [r for r in named if r[2] == "n3"]
    assert [r["id"] for r in got.collect()] == [i for i, _ in brute(only, [1, 2, 0], 4, lambda a, b: float(np.linalg.norm(a - b)))]
    call = "SELECT * FROM nearest(TABLE(SELECT * FROM named_vectors WHERE {}), 'v', {}, 4, 'id')"
    assert spark.sql(call.format("id < 0", "array(1, 2, 0)")).count() == 0
    for query in ("CAST(NULL AS array<double>)", "array(1D, NULL, 2D)", "CAST(array() AS array<double>)"):
        assert spark.sql(call.format("true", query)).count() == 0


@pytest.mark.parametrize(
    "args,told",
    [
        ("'gone', array(1.0), 3, 'id'", "no column gone"),
        ("'name', array(1.0), 3, 'id'", "name is not an array of numbers"),
        ("'v', 'text', 3, 'id'", "the query must be an array"),
        ("'v', array(1.0), 0, 'id'", "k must be positive"),
        ("'v', array(1.0), 3, 'id', 'angle'", "the metric must be one of"),
    ],
)
def test_wrong_arguments_are_told_on_analysis(spark, named, args, told):
    with pytest.raises(AnalysisException, match=told):
        spark.sql(f"SELECT * FROM nearest(TABLE(named_vectors), {args})")


def test_a_column_called_distance_is_told(spark, named):
    with pytest.raises(AnalysisException, match="called distance"):
        spark.sql("SELECT * FROM nearest(TABLE(SELECT *, 1 AS distance FROM named_vectors), 'v', array(1.0), 3, 'id')")


class Feed:
    """A folder that gets files one after the other, and a stream over it that is started anew each time."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark.newSession(), str(root), schema
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")
        state.use_rocksdb(self.spark)
        os.makedirs(f"{self.root}/in")

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, job):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        out = job(stream).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.root}/out")


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_nearest_by_window_goes_on_after_a_restart(spark, tmp_path):
    schema = "g string, id long, v array<double>, at timestamp, distance_ string"
    rng = np.random.default_rng(5)
    rows = [(("a", "a", "b", None)[i % 4], i, rng.integers(0, 5, 2).astype(float).tolist() if i % 11 else None, at(i) if i % 13 else None, "x") for i in range(240)]
    job = lambda df: state.nearest_by_window(df, "g", "v", [1.0, 2.0], 3, "id", "at", "1 hour", "0 seconds")
    feed = Feed(spark, tmp_path, schema)
    for part in (rows[:90], rows[90:150]):  # the second hour is open when the first run ends
        feed.add(part)
    first = feed.run(job).count()
    for part in (rows[150:], [("z", 999, [0.0, 0.0], at(600), "x")]):
        feed.add(part)
    got = {tuple(r) for r in feed.run(job).collect()}
    whole = {tuple(r) for r in job(feed.spark.createDataFrame(rows, schema)).collect()}
    assert 0 < first < len(got) and got == whole
    assert {r[0] for r in got} == {"a", "b", None}


def test_first_of_template_keeps_state_and_forgets(spark, tmp_path):
    schema = "id long, sql string, at timestamp"
    rows = [(i, f"SELECT a{i % 3} FROM t WHERE x = {i}", at(i)) for i in range(30)] + [(98, None, at(30)), (99, "SELECT 1", None)]
    job = lambda df: state.first_of_template(df, "id", "sql", "at", n=2, forget="2 hours", late="0 seconds")
    feed = Feed(spark, tmp_path, schema)
    feed.add(rows[:4])
    assert {(r["id"], r["seen"]) for r in feed.run(job).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2)}
    feed.add(rows[4:])
    got = {(r["id"], r["seen"]) for r in feed.run(job).collect()}
    assert got == {(r["id"], r["seen"]) for r in job(feed.spark.createDataFrame(rows, schema)).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)}
    feed.add([(200, "SELECT other", at(400))])  # moves the watermark beyond all that is known
    feed.run(job)
    feed.add([(201, "SELECT a0 FROM t WHERE x = 7", at(401))])
    assert {(r["id"], r["seen"]) for r in feed.run(job).collect()} - got == {(200, 1), (201, 1)}
