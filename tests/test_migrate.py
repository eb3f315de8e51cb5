"""Tables to and from servers, migration with its report, schema texts, configuration."""

import json

import pytest

from quillon import config
from quillon.sources import catalog, migrate


@pytest.fixture(scope="module")
def server(tmp_path_factory):
    """An embedded database that comes with Spark."""
    return f"jdbc:derby:{tmp_path_factory.mktemp('derby') / 'db'};create=true"


def test_a_table_goes_to_a_server_and_back(spark, server):
    rows = spark.range(50).selectExpr("id", "concat('text ', id) AS body", "array(cast(id AS float), 0.5f) AS body_embedding", "IF(id % 7 = 0, NULL, id / 4) AS part")
    catalog.write_jdbc(rows, server, "docs", batch=7, mode="overwrite")
    back = catalog.jdbc(spark, server, "docs", partition="id", bounds=(0, 50), parts=4)
    assert back.rdd.getNumPartitions() == 4
    got = {r["id"]: (r["body"], json.loads(r["body_embedding"]), r["part"]) for r in back.collect()}
    assert got == {i: (f"text {i}", [float(i), 0.5], None if i % 7 == 0 else i / 4) for i in range(50)}


def test_migration_reports_and_resumes(spark, server, tmp_path):
    spark.range(30).selectExpr("id", "concat('t', id) AS body").write.parquet(str(tmp_path / "in/one.parquet"))
    spark.range(0).selectExpr("id").write.parquet(str(tmp_path / "in/none.parquet"))
    tables = catalog.discover(spark, str(tmp_path / "in")) | {"gone": str(tmp_path / "in/gone.parquet")}
    targets = [server, str(tmp_path / "out"), "jdbc:derby:memory:absent"]
    for status in ("written", "present"):
        report = {(r["table"], r["target"]): (r["status"], r["rows"]) for r in migrate.migrate(spark, tables, targets).collect()}
        assert len(report) == 9
        assert all(report[t, at] == ("failed", None) for t, at in report if t == "gone" or at == targets[2])
        for at in targets[:2]:
            assert report["one", at] == (status, 30) and report["none", at] == (status, 0)
    assert spark.read.parquet(str(tmp_path / "out/one.parquet")).count() == catalog.jdbc(spark, server, '"one"').count() == 30
    spark.range(3).selectExpr("id", "'x' AS body").write.mode("overwrite").parquet(str(tmp_path / "in/one.parquet"))
    again = {(r["table"], r["target"]): (r["status"], r["rows"]) for r in migrate.migrate(spark, {"one": tables["one"]}, targets[:2]).collect()}
    assert set(again.values()) == {("written", 3)}


def test_keys_of_a_server(spark, server):
    con = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(server)
    for text in (
        "CREATE TABLE owners (a INT NOT NULL, b INT NOT NULL, PRIMARY KEY (b, a))",
        "CREATE TABLE pets (id INT NOT NULL PRIMARY KEY, x INT, y INT, FOREIGN KEY (x, y) REFERENCES owners (b, a))",
    ):
        con.createStatement().execute(text)
    con.close()
    got = {tuple(r) for r in catalog.server_keys(spark, server, ["OWNERS", "PETS", "ABSENT"]).collect()}
    assert got == {("OWNERS", "B", 0, None, None), ("OWNERS", "A", 1, None, None), ("PETS", "ID", 0, None, None), ("PETS", "X", None, "OWNERS", "B"), ("PETS", "Y", None, "OWNERS", "A")}


def test_schema_texts(spark, server):
    catalog.write_jdbc(spark.range(1).selectExpr("id", "'x' AS body"), server, "described", mode="overwrite")
    got = {r["table_name"]: r["ddl"] for r in migrate.schema_texts(spark, {"described": catalog.jdbc(spark, server, "described"), "v": spark.range(1)}, "clickhouse").collect()}
    assert "`ID`" in got["described"].upper() and "Int64" in got["described"] and got["v"].startswith("CREATE TABLE `v`")


def test_configuration(spark, tmp_path):
    tree = {"sqlite": {"base_dir": "/data", "bird": {"services": {"port": 1}, "paths": {"in": "{dataset}/a.json", "more": ["x-{dataset}", 3]}, "parameters": {"note": "{dataset}"}}}}
    (tmp_path / "c.json").write_text(json.dumps(tree))
    got = config.load(spark, str(tmp_path / "c.json"), "sqlite", "bird")
    assert got == config.RunConfig("/data", {"port": 1}, {"in": "bird/a.json", "more": ["x-bird", 3]}, {"note": "{dataset}"})
    for backend, dataset in (("sqlite", "spider"), ("oracle", "bird")):
        with pytest.raises(KeyError, match=f"{backend}.{dataset}"):
            config.configured(tree, backend, dataset)
