"""Rewriter, functions, metrics, corpus and schema operators on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import compat
from quillon.operators import corpus, knn, metrics, vectorize
from quillon.plans import classify
from quillon.plans.vectorsql import VectorSqlError, rewrite
from quillon.session import VectorSession
from quillon.sources import catalog, files, schemas
from quillon.streaming import jobs

COLUMNS = {"docs": ["id", "title", "emb"], "tags": ["doc_id", "tag"]}.get


def columns_of(table):
    return COLUMNS(table) or []


@pytest.fixture(scope="module")
def session(spark):
    rows = [(i, f"doc {i}", [float(i), 0.0]) for i in range(10)]
    spark.createDataFrame(rows, "id int, title string, emb array<float>").createOrReplaceTempView("docs")
    spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(10)], "doc_id int, tag string").createOrReplaceTempView("tags")
    known = {"zero": [0.0, 0.0], "it's\nnine": [9.0, 0.0]}
    return VectorSession(spark, default=vectorize.TableEmbedder(known, 2))


def ids(df):
    return [r[0] for r in df.collect()]


def test_match_cuts_before_joins_and_filters_of_other_tables(session):
    text = "SELECT d.id FROM docs d JOIN tags t ON d.id = t.doc_id WHERE d.emb MATCH lembed('m', 'zero') AND d.k = 4 AND t.tag = 'odd' ORDER BY d.id"
    assert ids(session.sql(text)) == [1, 3]


def test_match_filters_of_its_own_table_apply_inside(session):
    assert ids(session.sql("SELECT id FROM docs WHERE emb MATCH lembed('m', 'zero') AND k = 3 AND id BETWEEN 4 AND 8 ORDER BY distance")) == [4, 5, 6]


def test_limit_serves_as_bound_and_texts_are_unescaped(session):
    assert ids(session.sql("SELECT id FROM docs WHERE emb MATCH lembed('m', 'it''s\nnine') ORDER BY distance LIMIT 2")) == [9, 8]


def test_match_takes_literal_vectors(session):
    assert ids(session.sql("SELECT id FROM docs WHERE emb MATCH '[5.0, 0.0]' AND k = 1")) == [5]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT id FROM docs WHERE emb MATCH lembed('m', 'zero')",
        "SELECT id FROM docs WHERE emb MATCH lembed('m', 'zero') OR id = 1 AND k = 2",
        "SELECT d.id FROM docs d JOIN tags t ON d.id = t.doc_id WHERE nowhere MATCH lembed('m', 'zero') AND d.k = 2",
        "SELECT emb <=> lembed('m', 'zero') FROM docs",
        "SELECT lembed('m', id) FROM docs",
    ],
)
def test_statements_that_cannot_be_rewritten(text):
    with pytest.raises(VectorSqlError):
        rewrite(text, columns_of=columns_of)


def test_one_embedding_per_distinct_text():
    s = rewrite("SELECT L2Distance(e, lembed('m', 'x')) + L2Distance(e, lembed(m, \"x\")) FROM t", "clickhouse")
    assert s.embeddings == [("m", "x")] and s.sql.count(":v0") == 2


def test_validate_and_timeout(session):
    assert session.validate("SELECT id FROM docs")[0] == "success"
    assert session.validate("SELECT nothing FROM docs")[0] == "error"
    slow = session.execute("SELECT sum(a.id * b.id) FROM range(300000) a CROSS JOIN range(300000) b", timeout=2)
    assert slow.status == "error" and "timed out" in slow.message
    assert session.execute("SELECT id FROM docs LIMIT 3").row_count == 3
    both = session.execute_all([("a", "SELECT 1"), ("b", "SELECT missing FROM docs")])
    assert both["a"].status == "success" and both["b"].status == "error"


@pytest.mark.parametrize("level,text", [(n, s) for n, s in __import__("quillon.catalogue", fromlist=["x"])._LEVELS])
def test_integration_levels(level, text):
    assert classify.integration_level(text.format(text="FROM a GROUP BY MATCH it''s UNION", k=3)) == level


def test_compat_edges(spark):
    one = lambda name, *args: spark.range(1).select(compat.expr(name, *args)).first()[0]
    assert one("LOG", "100D") == 2 and one("MAX", "1", "NULL") is None and one("SQRT", "-1") is None
    assert one("SUBSTR", "'hello'", "0", "2") == "h" and one("SUBSTR", "'hello'", "4", "-2") == "el"
    assert one("UNHEX", "'4'") is None and one("SOUNDEX", "'12'") == "?000" and one("HEX", "255") == "323535"
    assert one("CHAR", "65", "8364") == "A€" and one("TYPEOF", "1.5D") == "real" and one("TRUNC", "-1.7D") == -1
    assert one("DATE", "'2024-01-31'", "'+1 month'") == "2024-02-29" and one("JULIANDAY", "'2000-01-01 12:00:00'") == 2451545.0
    assert one("TIMEDIFF", "'2024-03-01 10:00:00'", "'2024-02-01 08:30:00'") == "+0000-01-00 01:30:00.000"
    assert one("GLOB", "'a[bc]*'", "'acid'") is True and one("STRFTIME", "'%d.%m.%Y'", "'2024-05-06'") == "06.05.2024"
    with pytest.raises(compat.Unsupported):
        compat.translate("LOAD_EXTENSION", ["'x'"])


def test_metrics_follow_the_rules_of_empty_sides(spark):
    cases = spark.createDataFrame([(i, i != 5) for i in range(6)], "query_id int, ok boolean")
    predicted = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (2, 1, "x"), (4, 1, "z"), (4, 2, "a"), (5, 1, "a")], "query_id int, pos int, row string")
    gold = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 1, 1, "a"), (1, 0, 1, "a"), (4, 0, 1, "a"), (4, 0, 2, "c")], "query_id int, run_id int, pos int, row string")
    got = {r["query_id"]: r.asDict() for r in metrics.evaluate(cases, predicted, gold).collect()}
    assert got[0]["exact_match"] == 1 and got[0]["f1"] == 1 and got[0]["ndcg"] == pytest.approx(1)
    assert (got[1]["precision"], got[1]["recall"], got[1]["f1"], got[1]["map"]) == (1, 0, 0, 0)
    assert (got[2]["precision"], got[2]["recall"], got[2]["f1"], got[2]["exact_match"]) == (0, 1, 0, 0)
    assert all(got[3][s] == 1 for s in metrics.SCORES)
    assert (got[4]["precision"], got[4]["recall"], got[4]["map"], got[4]["mrr"]) == (0.5, 0.5, 0.25, 0.5)
    assert got[5]["f1"] is None
    total = metrics.summary(metrics.evaluate(cases, predicted, gold)).first()
    assert total["total_cases"] == 6 and total["count_f1"] == 5 and total["average_f1"] == total["average_f1_score"]


def test_judge_and_comparable(spark):
    df = spark.createDataFrame([('x {"ACC_SQL": 1, "ACC_Vec": 0} y',), ("none",)], "answer string")
    assert [r["acc"] for r in metrics.judged(df, "answer").collect()] == [0.5, 0.0]
    row = spark.createDataFrame([(1, 0.5, None)], "a int, distance double, b string")
    assert row.select(metrics.comparable(row, ["b", "distance", "a"], ["a", "b", "distance"])).first()[0].startswith('{"b"')


def test_knn_join_agrees_with_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<float>")
    for metric in ("l2", "cosine", "ip"):
        got = {(r["query_key"], r["rank"]): r["key"] for r in knn.knn_join(df, df.filter("id < 7"), 3, "id", "v", metric).collect()}
        d = knn._distances(x.astype(float), x.astype(float), metric)
        np.fill_diagonal(d, np.inf)
        assert all(got[i, r + 1] == np.argsort(d[i])[r] for i in range(7) for r in range(3))


def test_knn_join_of_equal_vectors_gives_zero(spark):
    v = [1000.1, 2000.2, 3000.3]
    df = spark.createDataFrame([(i, v) for i in range(6)] + [(9, [1000.1, 2000.2, 3000.4])], "id long, v array<double>")
    got = knn.knn_join(df, df.filter("id = 3"), 6, "id", "v").orderBy("rank").collect()
    assert [r["key"] for r in got] == [0, 1, 2, 4, 5, 9] and [r["distance"] for r in got[:5]] == [0.0] * 5 and abs(got[5]["distance"] - 0.1) < 1e-9


def test_index_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((20, 8))[rng.integers(0, 20, 600)] + 0.1 * rng.standard_normal((600, 8))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    index = knn.VectorIndex.build(df, "id", "v", str(tmp_path / "ivf"), lists=12)
    again = knn.VectorIndex.build(df, "id", "v", str(tmp_path / "ivf"))
    assert np.allclose(index.centroids, again.centroids)
    assert spark.read.parquet(str(tmp_path / "ivf/rows")).count() == 600
    hits = 0
    for q in range(0, 600, 100):
        best = set(np.argsort(((x - x[q]) ** 2).sum(1))[:5].tolist())
        hits += len(best & {r["id"] for r in index.search(spark, "v", x[q].tolist(), 5, probes=4).collect()})
    assert hits >= 27


def test_index_recall_by_default(spark, tmp_path):
    df, asked = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0
    index = knn.VectorIndex.build(df, "vec_id", "embedding", str(tmp_path / "ivf"), queries=asked)
    assert knn.VectorIndex.build(df, "vec_id", "embedding", str(tmp_path / "ivf")).measured == index.measured
    assert index.probes_for(101) == len(index.centroids) == 44
    # a fifth of the rows at most is read in full
    assert index.taken_for(10) <= 2000 / 5 and index.taken_for(10) >= 11
    found = {(r["query_key"], r["key"]): r for r in index.search_all(df.filter(asked), "vec_id", "embedding", 10).collect()}
    true = {(r["query_key"], r["key"]): r["distance"] for r in knn.knn_join(df, df.filter(asked), 10, "vec_id", "embedding", skip_self=False).collect()}
    assert len(true) == 1000 and len(true.keys() & found.keys()) >= 900
    assert all(found[p]["distance"] == pytest.approx(true[p]) for p in true.keys() & found.keys())
    # a single search finds what the search for a table does
    for r in df.filter("vec_id IN (20, 40)").collect():
        got = [x["vec_id"] for x in index.search(spark, "embedding", r["embedding"], 10).collect()]
        assert got == [k for _, k in sorted((v["rank"], key) for (q, key), v in found.items() if q == r["vec_id"])]


def test_index_codes_of_a_hot_list(spark, tmp_path, monkeypatch):
    # one list holds nearly all rows, and is dealt to several parts; queries to several salts
    monkeypatch.setattr(knn.VectorIndex, "DEALT", 16)
    rng = np.random.default_rng(3)
    x = np.vstack((rng.normal(size=(200, 5)) / 100, rng.normal(size=(20, 5)) + 30))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    index = knn.VectorIndex.build(df, "id", "v", str(tmp_path / "hot"), lists=3)
    found = index.search_all(df.filter("id < 40"), "id", "v", 3).collect()
    hits = sum(r["key"] in set(np.argsort(((x - x[r["query_key"]]) ** 2).sum(1))[:3].tolist()) for r in found)
    assert len(found) == 120 and hits >= 108
    code, scale = knn._encode(x - x.mean(0))
    assert np.abs(knn._decode(code, scale, 5) - (x - x.mean(0))).max() <= scale.max() / 15 + 1e-9


def test_medoid_and_votes(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.9, 0.1]), (1, "c", [0.0, 1.0]), (2, "d", [1.0, 0.0]), (3, "f", [1.0, 0.0]), (3, "e", [0.0, 1.0])], "c int, k string, v array<float>")
    assert {r["case"]: r["key"] for r in corpus.question_vote(df, "c", "k", "v").collect()} == {1: "b", 2: "d", 3: "e"}
    votes = spark.createDataFrame([(1, "r1", "x"), (1, "r2", "x"), (1, "r2", "x"), (1, "r3", "y"), (2, "r1", "x"), (2, "r2", "x")], "c int, r string, row string")
    assert [tuple(r) for r in corpus.majority_vote(votes, "c", "r", "row").collect()] == [(1, "r1", 2)]


def test_medoids_leave_out_vectors_without_a_direction(spark):
    rows = [(1, 10, [1.0, 0.0]), (1, 11, [2.0, 0.1]), (1, 12, [3.0, 0.2]), (1, 1, [0.0, 0.0]), (1, 2, None), (1, 3, [1.0, None]), (1, 4, [1.0, float("nan")]), (None, 5, [1.0, 0.0]), (2, 6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    assert sorted((r["group"], r["key"]) for r in knn.medoids(df, "g", "k", "v").collect()) == [(1, 11), (2, 6)]
    assert knn.medoids(df.limit(0), "g", "k", "v").count() == 0


def test_vectors_without_a_width_in_ddl(spark):
    _, schema = schemas.from_ddl("CREATE VIRTUAL TABLE t USING vec0 (id INTEGER, a float[3])")
    assert '"a" vector(3)' in schemas.to_ddl("t", schema, "postgresql")
    assert '"v" vector\n' in schemas.to_ddl("t", spark.createDataFrame([], "v array<float>").schema, "postgresql")


def test_corpus_helpers(spark):
    base = spark.range(200)
    assert corpus.sample_rows(base, 20, "id").collect() == corpus.sample_rows(base, 20, "id").collect()
    assert corpus.mix_ratio(spark.range(10), spark.range(500), 1, 3, "id").count() == 40
    assert corpus.mix_ratio(spark.range(10), spark.range(12), 1, 3, "id").count() == 22
    g = base.select(corpus.geometric(0.6, "id").alias("g"), corpus.table_count(10, 4, 1, 20, "id").alias("n"), corpus.pick(["a", "b"], "id").alias("p"))
    low, mean, few, most, styles = g.agg(F.min("g"), F.avg("g"), F.min("n"), F.max("n"), F.count_distinct("p")).first()
    assert low == 1 and 1.2 < mean < 2.3 and few >= 1 and most <= 20 and styles == 2
    assert spark.range(1).select(F.lit(2).alias("rich")).transform(lambda d: corpus.synthesis_loops(d, 3, "rich")).count() == 6
    text = spark.createDataFrame([("q {x}", "SELECT Title FROM t")], "f string, s string")
    assert text.select(corpus.fill("Use {s}!", s="s")).first()[0] == "Use SELECT Title FROM t!"
    assert text.select(corpus.used_columns(F.col("s"), F.array(F.lit("title"), F.lit("year")))).first()[0] == ["title"]
    names = spark.createDataFrame([("/a/x.sqlite",), ("/b/x.sqlite",), ("/b/y.sqlite",)], "p string")
    assert [tuple(r) for r in corpus.repeated_names(names, "p").collect()] == [("x", 2)]


def test_schemas(spark):
    name, schema = schemas.from_ddl('CREATE VIRTUAL TABLE "t" USING vec0(id INTEGER, at DATETIME, distance REAL, 2x TEXT, body_embedding float[3], PRIMARY KEY (id))')
    assert name == "t" and [f.dataType.simpleString() for f in schema] == ["bigint", "timestamp", "double", "string", "array<float>"]
    assert schema.names[2:4] == ["distance_val", "fld_2x"] and schema["body_embedding"].metadata == {"dim": 3}
    assert "vector(3)" in schemas.to_ddl("t", schema, "postgresql") and "hnsw" in schemas.to_ddl("t", schema, "clickhouse") and "MSTG" in schemas.to_ddl("t", schema, "myscale")
    rows = spark.createDataFrame([("7", "2024-02-03 04:05:06.25", "nan", None, [1.0])], "id string, at string, distance_val string, fld_2x string, body_embedding array<float>")
    got = schemas.coerce(rows, schema, zero_nulls=True).first()
    assert got["id"] == 7 and got["at"].year == 2024 and got["distance_val"] == 0 and got["fld_2x"] == "" and got["body_embedding"] == [1, 0, 0]
    described = spark.createDataFrame([("d", "a", ["x"], [("x", "b", "y"), ("x", "b", "no")]), ("d", "b", ["y"], []), ("d", "c", [], [])], "db_id string, table_name string, columns array<string>, foreign_keys array<struct<column:string,ref_table:string,ref_column:string>>")
    kept = {r["table_name"]: len(r["foreign_keys"]) for r in schemas.valid_tables(described).collect()}
    assert kept == {"a": 1, "b": 0}
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(15)], F.array(F.lit(1.0)).alias("a_embedding"), F.array(F.lit(1.0)).alias("b_embedding"))
    assert schemas.narrow(wide).columns[-1] == "a_embedding" and len(schemas.narrow(wide).columns) == 16


def test_files_and_catalog(spark, tmp_path):
    import datetime
    import decimal

    df = spark.createDataFrame([("b", datetime.date(2024, 1, 2), decimal.Decimal("1.50"), b"xy"), ("a", None, None, None)], "query_id string, d date, n decimal(10,2), blob binary")
    files.write_results(df, str(tmp_path / "r"))
    back = files.read_json(spark, str(tmp_path / "r"), lines=True).collect()
    assert {r["query_id"] for r in back} == {"a", "b"} and next(r for r in back if r["query_id"] == "b")["blob"] == "eHk="
    cache = spark.createDataFrame([("a", None), ("b", "broken")], "query_id string, error string")
    assert [r["query_id"] for r in files.missing_from_cache(df, cache).collect()] == ["b"]
    df.select("query_id").write.parquet(str(tmp_path / "db" / "My-Table.parquet"))
    assert list(catalog.discover(spark, str(tmp_path / "db"))) == ["my_table"]
    spark.createDataFrame([("t", [1.0])], "body string, body_embedding array<float>").createOrReplaceTempView("v")
    assert [r["base_column"] for r in catalog.describe(spark, ("v",)).collect()] == [None, "body"]
    assert catalog.is_empty([df.limit(0)]) and not catalog.is_empty([df])


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("SELECT 1", "2024-01-01 00:00:00"), ("SELECT  2", "2024-01-01 00:01:00"), ("SELECT a", "2024-01-01 00:02:00")], "sql string, at string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.first_templates(stream, "sql", "at").writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("first").count() == 2
    q = jobs.vectorized(stream, ["sql"], vectorize.HashEmbedder).writeStream.format("memory").queryName("vec").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {len(r["sql_embedding"]) for r in spark.table("vec").collect()} == {64}


def test_images_that_are_missing_give_zeros(spark, tmp_path):
    class Bytes:
        dim = 2

        def embed_images(self, images):
            return np.array([[len(i), 1.0] for i in images])

    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"123")
    rows = spark.createDataFrame([("a.png",), ("b.png",)], "image string")
    got = {r["image"]: list(r["image_embedding"]) for r in vectorize.vectorize_images(rows, "image", str(tmp_path / "img"), Bytes, spark).collect()}
    assert got == {"a.png": [3.0, 1.0], "b.png": [0.0, 0.0]}


def test_literals_stay_as_they_are(session):
    q = lambda text, dialect="sqlite": rewrite(text, dialect, columns_of).sql
    assert "'Dr. Smith . x'" in q("SELECT d.id FROM docs d WHERE d.title = 'Dr. Smith . x'")
    assert "d.id" in q("SELECT d . id FROM docs d") and "'%. %'" in q("SELECT id FROM docs d WHERE d.title LIKE '%. %'", "postgresql")
    row = session.sql(r"SELECT '(?s)a\nb''c' AS a, UPPER('x. y\') AS b, 'é . ' || d.id AS c, CAST(d.id AS TEXT) AS e FROM docs d WHERE d.id = 3").first()
    assert tuple(row) == (r"(?s)a\nb'c", "X. Y" + chr(92), "é . 3", "3")


def test_cases_run_with_a_row_for_each_statement(session, spark, tmp_path):
    cases = [
        {"query_id": "a", "predicted_sql": "SELECT d.id AS x, d.id AS x FROM docs d ORDER BY d.id", "sql_candidate": ["SELECT id FROM docs WHERE id < 3", "SELECT nothing FROM docs"]},
        {"query_id": "b", "sql": "SELECT d.id FROM docs d WHERE d.emb MATCH lembed('m', 'zero') AND d.k = 4"},
    ]
    got = {(r["query_id"], r["run_id"]): r for r in session.run_cases(cases, str(tmp_path)).collect()}
    assert {k: (r["status"], r["row_count"], r["integration_level"]) for k, r in got.items()} == {("a", -1): ("success", 10, 0), ("a", 0): ("success", 3, 0), ("a", 1): ("error", None, 0), ("b", -1): ("error", None, None), ("b", 0): ("success", 4, 1)}
    rows = spark.read.parquet(got["a", -1]["path"]).orderBy("pos").collect()
    assert [r["row"] for r in rows] == [f'["{i}","{i}"]' for i in range(10)]
    kept = session.runnable(spark.createDataFrame([("SELECT id FROM docs",), ("SELECT 1 / ASSERT_TRUE(false)",), (None,)], "sql string"), str(tmp_path / "r")).collect()
    assert [(r["sql"], r["column_count"], r["row_count"]) for r in kept] == [("SELECT id FROM docs", 1, 10)]


def test_keys_of_ddl():
    primary, foreign = schemas.keys_of_ddl("CREATE TABLE t (id INTEGER PRIMARY KEY, a INT REFERENCES u(x), b INT, c NUMERIC(3, 2), -- note\n FOREIGN KEY (b, c) REFERENCES \"v\" (y, z), CONSTRAINT q FOREIGN KEY (a) REFERENCES w)")
    assert primary == ["id"] and foreign == [("a", "u", "x"), ("b", "v", "y"), ("c", "v", "z"), ("a", "w", "a")]
    assert schemas.keys_of_ddl("CREATE TABLE t (a INT, b INT, PRIMARY KEY (a, b))") == (["a", "b"], [])


def test_a_database_is_vectorized_and_resumed(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    spark.range(3).selectExpr("id", "concat('text ', id) AS body").write.parquet(str(root / "one.parquet"))
    spark.range(2).selectExpr("id").write.parquet(str(root / "two.parquet"))
    found = catalog.databases(spark, str(tmp_path))
    assert list(found) == ["in/deep"] and sorted(found["in/deep"]) == ["one", "two"]
    tables = found["in/deep"] | {"gone": str(root / "gone.parquet")}
    for status in ("written", "present"):
        report = {r["table"]: (r["status"], r["rows"]) for r in vectorize.vectorize_database(spark, tables, {"one": ["body"]}, str(tmp_path / "out"), vectorize.HashEmbedder).collect()}
        assert report == {"gone": ("failed", None), "one": (status, 3), "two": (status, 2)}
    assert spark.read.parquet(str(tmp_path / "out" / "one.parquet")).columns == ["id", "body", "body_embedding"]


def test_percent_report_and_dialogue(spark):
    scores = spark.createDataFrame([("m", "x", "d", 0.5, 1.0), ("m", "x", "d", 1.0, 0.0), ("m", "y", "d", 0.25, None), ("n", "x", "d", 1.0, 1.0)], "model string, backend string, dataset string, f1 double, map double")
    got = {r["model"]: r.asDict() for r in metrics.percent_report(scores, "f1", "map").collect()}
    assert got["m"] == {"model": "m", "x_d": "75.0 / 50.0", "y_d": "25.0 / 0.0", "macro_average": "50.0 / 25.0"}
    assert got["n"]["y_d"] == "- / -" and got["n"]["macro_average"] == "100.0 / 100.0"
    turns = spark.createDataFrame([(1, 2, "assistant", "yes"), (1, 1, "user", "well?"), (2, 1, "user", None)], "c int, turn int, role string, text string")
    assert {r["case"]: r["dialogue"] for r in corpus.dialogue(turns, "c", "turn", "role", "text").collect()} == {1: "user: well?\nassistant: yes", 2: "user: "}
