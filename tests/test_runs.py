"""Runs that break off and are resumed: statements, vectors, migration by contents."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import vectorize
from quillon.session import VectorSession
from quillon.sources import catalog, migrate


class Broken(Exception):
    pass


def test_a_broken_run_of_statements_is_resumed(spark, tmp_path, monkeypatch):
    spark.range(10).write.parquet(str(tmp_path / "db/docs.parquet"))
    session = VectorSession(spark, str(tmp_path / "db"))
    texts = [f"SELECT id FROM docs WHERE id < {i}" for i in range(6)] + ["SELECT gone FROM docs", None]
    statements = spark.createDataFrame([(t,) for t in texts + texts], "sql string")
    ran, real = [], session.run_into

    def run_into(text, *rest):
        if len(ran) == 4:
            raise Broken
        ran.append(text)
        return real(text, *rest)

    monkeypatch.setattr(session, "run_into", run_into)
    with pytest.raises(Broken):
        session.run_statements(statements, str(tmp_path / "out"), threads=1, flush=1)
    assert len(ran) == 4
    again = []
    monkeypatch.setattr(session, "run_into", lambda text, *rest: again.append(text) or real(text, *rest))
    found = {r["sql"]: r for r in session.run_statements(statements, str(tmp_path / "out"), threads=3, flush=2).collect()}
    assert sorted(ran + again) == sorted(t for t in texts if t)  # each ran once
    assert {t: (r["status"], r["row_count"]) for t, r in found.items()} == {t: ("error", None) if "gone" in t else ("success", i) for i, t in enumerate(texts) if t}
    assert spark.read.parquet(found[texts[5]]["path"]).count() == 5
    kept = session.run_statements(statements, str(tmp_path / "out"))
    assert kept.count() == 7 and len(again) == 3


def test_cases_of_a_table(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "db/docs.parquet"))
    session = VectorSession(spark, str(tmp_path / "db"))
    cases = spark.createDataFrame([("a", "SELECT id FROM docs", ["SELECT id FROM docs", "SELECT 1 AS x"], None), ("b", None, [], "SELECT id + 1 AS y FROM docs"), ("c", None, None, None)], "query_id string, predicted_sql string, sql_candidate array<string>, sql string")
    got = {(r["query_id"], r["run_id"]): r for r in session.run_cases(cases, str(tmp_path / "out"), schema="CREATE TABLE docs (id)").collect()}
    assert {k: (r["status"], r["row_count"], r["columns"]) for k, r in got.items()} == {
        ("a", -1): ("success", 4, ["id"]), ("a", 0): ("success", 4, ["id"]), ("a", 1): ("success", 1, ["x"]), ("b", -1): ("error", None, []), ("b", 0): ("success", 4, ["y"]), ("c", -1): ("error", None, []),
    }
    assert {(r["db_type"], r["schema"]) for r in got.values()} == {("sqlite", "CREATE TABLE docs (id)")}


def test_only_changed_texts_are_embedded(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.range(40).select("id", F.concat(F.lit("text "), (F.col("id") % 10).cast("string")).alias("a"), F.when(F.col("id") > 0, "same").alias("b"))
    assert vectorize.remember(rows, ["a", "b"], store, vectorize.HashEmbedder) == 12  # ten texts, one that all share, and the empty one
    assert vectorize.remember(rows, ["a", "b"], store, vectorize.HashEmbedder, steps=3) == 0
    changed = rows.withColumn("a", F.when(F.col("id") == 7, "new words").otherwise(F.col("a")))
    assert vectorize.remember(changed, ["a", "b"], store, vectorize.HashEmbedder, steps=3) == 1
    got = vectorize.with_vectors(changed, ["a", "b"], store)
    want = vectorize.vectorize(changed, ["a", "b"], vectorize.HashEmbedder)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert vectorize.with_vectors(rows.select(F.lit("unknown").alias("a")).limit(1), ["a"], store).first()["a_embedding"] is None


@pytest.mark.parametrize("kind", ["folder", "server"])
def test_a_changed_row_is_found(spark, tmp_path, kind):
    target = str(tmp_path / "out") if kind == "folder" else f"jdbc:derby:{tmp_path / 'derby'};create=true"
    rows = spark.range(20).selectExpr("id", "IF(id = 3, NULL, concat('t', id)) AS body", "IF(id = 4, NULL, id / 3) AS part", "array(cast(id AS float)) AS v")
    path = str(tmp_path / "in/one.parquet")
    rows.write.parquet(path)
    run = lambda: migrate.migrate(spark, {"one": path}, [target]).first()["status"]
    assert [run(), run()] == ["written", "present"]
    rows.withColumn("body", F.when(F.col("id") == 9, "other").otherwise(F.col("body"))).write.mode("overwrite").parquet(path)  # as many rows as before
    assert [run(), run()] == ["written", "present"]
    if kind == "folder":  # changed at the target
        spark.read.parquet(path).withColumn("part", -F.col("part")).write.parquet(f"{target}/tmp")
        spark.read.parquet(f"{target}/tmp").write.mode("overwrite").parquet(f"{target}/one.parquet")
        assert [run(), run()] == ["written", "present"]
    # nulls change places: not the same rows
    assert migrate.digest(spark.sql("SELECT NULL AS a, 1 AS b")) != migrate.digest(spark.sql("SELECT 1 AS a, NULL AS b"))
    assert migrate.digest(rows) == migrate.digest(rows.repartition(3)) and catalog.discover(spark, str(tmp_path / "in")).keys() == {"one"}
