"""Exact search through an index, where codes alone would miss rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalogue
from quillon.operators import knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def crowd(rng, n, dim, group, apart):
    """n vectors, and a group about vector 17 whose codes hardly differ; its ids aren't among those that measure the index."""
    x = rng.normal(size=(n, dim)).astype("f4")
    near = (x[17] + apart * rng.normal(size=(group, dim))).astype("f4")
    ids = [n + 20 * i + 1 + i % 19 for i in range(group)]
    return [(i, v.tolist(), i % 10) for i, v in enumerate(x)] + [(i, v.tolist(), 0) for i, v in zip(ids, near)]


def same_as_sql(spark, folder):
    got = [tuple(r) for r in catalogue.queries()["index_search"](spark, str(folder)).collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert got == duck.execute(catalogue.oracle_sql()["index_search"]).fetchall()


@pytest.mark.parametrize("row", [83, 109, 168])
def test_index_search_equals_its_sql_from_other_rows(spark, tmp_path, row):
    # rows whose ten nearest aren't all among those of the least estimates take the place of 17
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    swapped = F.when(F.col("vec_id") == 17, row).when(F.col("vec_id") == row, 17).otherwise(F.col("vec_id"))
    e.withColumn("vec_id", swapped.cast("long")).write.parquet(f"{tmp_path}/embeddings.parquet")
    same_as_sql(spark, tmp_path)


@pytest.mark.parametrize("apart", [1e-3, 0.0])
def test_index_search_equals_its_sql_on_odd_rows(spark, tmp_path, apart):
    # near rows, or copies, are more than what is taken by estimates; others are null or no numbers
    rows = crowd(np.random.default_rng(5), 600, 64, 150, apart)
    rows += [(9001, None, 1), (9002, [float("nan")] * 64, 1), (9003, [float("inf")] * 64, 1), (9004, [0.0] * 64, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    same_as_sql(spark, tmp_path)


def test_exact_search_equals_search_without_an_index(spark, tmp_path, monkeypatch):
    rows = crowd(np.random.default_rng(6), 400, 16, 60, 1e-3) + [(9001, None, 1), (9002, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    index = knn.VectorIndex.build(df, "vec_id", "embedding", str(tmp_path / "ivf"), queries=F.col("vec_id") % 20 == 0)
    # opened again; also with one list read at first, more keys than are broadcast, and more rows asked for than there are
    index = knn.VectorIndex.build(df, "vec_id", "embedding", str(tmp_path / "ivf"))
    for query, k, probes, most in ((17, 10, None, 200_000), (17, 10, 1, 3), (3, 10, 1, 200_000), (17, 130, None, 3), (5, 1000, None, 200_000)):
        monkeypatch.setattr(knn.VectorIndex, "BROADCAST", most)
        at = rows[query][1]
        found, plain = index.search(spark, "embedding", at, k, probes, exact=True), knn.knn(df, "embedding", at, k, "vec_id")
        assert found.columns == ["vec_id", "embedding", "label", "distance"]
        assert [(r["vec_id"], str(r["distance"])) for r in found.collect()] == [(r["vec_id"], str(r["distance"])) for r in plain.collect()]
    # a search reads in full what is near, not all
    left = index._possible(spark, np.asarray([rows[17][1]]), knn.knn(df, "embedding", rows[17][1], 10, "vec_id"), 10)
    assert 10 <= left.count() < 200


def test_codes_tell_their_error(spark, tmp_path):
    rows = crowd(np.random.default_rng(7), 300, 9, 20, 1e-3)
    df = spark.createDataFrame(rows, SCHEMA)
    index = knn.VectorIndex.build(df, "vec_id", "embedding", str(tmp_path / "ivf"))
    x, codes = {r[0]: np.asarray(r[1]) for r in rows}, spark.read.parquet(str(tmp_path / "ivf/codes")).toPandas()
    back = index.centroids[codes["centroid"].to_numpy()] + knn._decode(codes["code"], codes["scale"], 9)
    true = np.stack([x[k] for k in codes["key"]])
    assert len(codes) == 320 and np.allclose(np.sqrt(((true - back) ** 2).sum(1)), codes["error"], rtol=1e-6, atol=1e-6)
    assert codes["error"].max() <= codes["scale"].max() / 15 * 3 + 1e-9
