"""Queries that SQL can express, against DuckDB on the smallest tables, and on tables with links, copies and faults."""

import duckdb
import pytest

from quillon.llm import registry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if not folder.startswith('/root') else ''}'")
    ours = registry.queries()[name](spark, folder)
    columns = sorted(ours.columns)
    theirs = con.execute(registry.oracle_sql()[name])
    assert columns == sorted(d[0] for d in theirs.description)
    at = [[d[0] for d in theirs.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())
    assert sorted(repr(tuple(r)) for r in ours.select(*columns).collect()) == want
    return want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[:50] + words[50 : 50 + i % 4])) for i in range(12)] + [(20, "one two"), (21, "One  two"), (22, None), (23, ""), (24, "A b c d"), (25, "a B c d e")]
    token = "eyJhbGci.eyJzdWIi.c2ln_-"
    docs += [
        (30, "é🙂 PassWord = 'abcdef' token:abc secret: x api-key=no apikey=aaaaaa api_KEY:\"bbbbbb\" toKen=aaaaaaa"),
        (31, "AKIA" + "B" * 16 + "c AKIA" + "B" * 15 + " " + "0123456789abcdef" * 2 + "g" + "a" * 23 + "G" + "f" * 24),
        (32, f"{token} x{token} .{token}.{token} -{token}\n{token}"),
        (33, "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----" + " ghp_" + "a1" * 18 + " ghx_" + "a1" * 18 + "\U0001f642gho_" + "Z" * 40),
        (34, "password=" + "deadbeef" * 4 + " passwd:=x token==" + "A" * 9 + "secret='" + "AKIA" + "9" * 20),
        (35, "x " * 20_000 + "secret = hunter22"),
    ]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [1.0, 0.1 * (i % 5), 0.0]) for i in range(10)] + [(10, None), (11, [0.0] * 3), (12, [0.0, 0.0, -1.0]), (13, [1.0, None, 0.0])]
    spark.createDataFrame([(i, v, i % 2) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(5, "<p>x</p>"), (3, "<p>x</p>"), (4, None), (9, ""), (7, "é" * 300)]
    spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in pages], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    for t in ("benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_minhash_dedup", "op4_exact_dedup", "op6_warc_zip", "op10_embedding_dedup"])
def test_with_copies_and_links(spark, planted, name):
    compare(spark, name, planted)
