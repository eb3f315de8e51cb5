"""SQLite files and SQL scripts as sources."""

import os
import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import dump, sqlite


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sqlite") / "shop #1.db")
    con = sqlite3.connect(path)
    con.executescript("""
      CREATE TABLE owner (id INTEGER PRIMARY KEY, name TEXT);
      CREATE TABLE "the pets" (id INTEGER, owner INTEGER REFERENCES owner, weight REAL, photo BLOB, price DECIMAL(10, 2), v float[3], born DATE, good BOOLEAN, PRIMARY KEY (id, owner), FOREIGN KEY (owner) REFERENCES owner (id));
      CREATE TABLE pairs (a TEXT PRIMARY KEY, b INTEGER) WITHOUT ROWID;
      CREATE TABLE none (x INTEGER);
      CREATE VIEW heavy AS SELECT name FROM owner WHERE id > 90;
    """)
    con.executemany("INSERT INTO owner VALUES (?, ?)", [(i * 7, f"o'wner \n{i}") for i in range(100)])
    v = np.array([1, 2.5, -3], "<f4").tobytes()
    con.executemany('INSERT INTO "the pets" VALUES (?, ?, ?, ?, ?, ?, ?, ?)', [
        (1, 7, 1.5, b"\x00\xff", "2.50", v, "2024-02-03", 1), ("x", None, "heavy", "text", None, "[1, 2, 3]", "soon", 0), (3.0, 14, 2, None, 9, b"\x00", None, None),
    ])
    con.executemany("INSERT INTO pairs VALUES (?, ?)", [("a", 1), ("b", 2)])
    con.commit()
    con.close()
    return path


def test_a_table_by_ranges_of_rowid(spark, database):
    db = sqlite.Database(spark, database)
    rows = db.read("owner", parts=9)
    assert rows.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, rows.collect())) == [(i * 7, f"o'wner \n{i}") for i in range(100)]
    assert rows.filter("id > 600").select("name").count() == 14
    assert {tuple(r) for r in db.read("pairs").collect()} == {("a", 1), ("b", 2)}
    assert {r["name"] for r in db.read("heavy").collect()} == {f"o'wner \n{i}" for i in range(13, 100)}
    assert db.read("none").collect() == [] and not db.is_empty()
    with pytest.raises(ValueError, match="no table"):
        db.read("gone")


def test_values_that_do_not_fit_are_null(spark, database):
    rows = [tuple(r) for r in sqlite.Database(spark, database).read("the pets", parts=2).collect()]
    got = {r[0]: r[1:] for r in rows}
    assert got[1][0] == 7 and got[1][1] == 1.5 and bytes(got[1][2]) == b"\x00\xff" and float(got[1][3]) == 2.5 and got[1][4] == [1.0, 2.5, -3.0] and str(got[1][5]) == "2024-02-03" and got[1][6] is True
    assert got[None][0] is None and got[None][1] is None and bytes(got[None][2]) == b"text" and got[None][4] == [1.0, 2.0, 3.0] and got[None][5] is None and got[None][6] is False
    assert got[3][1] == 2.0 and got[3][4] == [] and float(got[3][3]) == 9


def test_keys(spark, database):
    got = {tuple(r) for r in sqlite.Database(spark, database).keys().collect()}
    assert got == {("owner", "id", 0, None, None), ("the pets", "id", 0, None, None), ("the pets", "owner", 1, None, None), ("pairs", "a", 0, None, None), ("the pets", "owner", None, "owner", "id")}


def test_states_of_files(spark, database, tmp_path):
    (tmp_path / "zero.db").write_bytes(b"")
    (tmp_path / "junk.sqlite").write_bytes(b"SQLite format 3\0" + b"junk" * 500)
    sqlite3.connect(tmp_path / "bare.sqlite3").execute("CREATE TABLE t (x)").connection.close()
    (tmp_path / "deep").mkdir()
    os.link(database, tmp_path / "deep/shop.db") if os.stat(database).st_dev == os.stat(tmp_path).st_dev else None
    states = {n: sqlite.Database(spark, str(tmp_path / n)) for n in ("zero.db", "junk.sqlite", "bare.sqlite3", "gone.db", "deep/shop.db")}
    assert {n: (d.state, d.is_empty()) for n, d in states.items()} == {"zero.db": ("empty", True), "junk.sqlite": ("corrupt", True), "bare.sqlite3": ("ok", True), "gone.db": ("missing", True), "deep/shop.db": ("ok", False)}
    with pytest.raises(ValueError, match="corrupt"):
        states["junk.sqlite"].read("t")
    images = sqlite.images_below(spark, str(tmp_path))
    found = {(r["path"].rsplit("/", 1)[1], r["state"], r["table_name"], r["rows"]) for r in sqlite.inventory(images).collect()}
    assert found == {("junk.sqlite", "corrupt", None, None), ("bare.sqlite3", "ok", "t", 0), *(("shop.db", "ok", t, n) for t, n in (("owner", 100), ("the pets", 3), ("pairs", 2), ("none", 0), ("heavy", 87)))}
    assert sqlite.read_all(spark, str(tmp_path), "owner", "id long, name string").count() == 100
    assert sqlite.read_all(spark, str(tmp_path), "owner", "id long, other string").count() == 0


def test_a_file_that_is_sent(spark, tmp_path):
    path = tmp_path / f"sent-{random.random()}.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (x INTEGER)")
    con.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(50)])
    con.commit()
    db = sqlite.Database(spark, f"file://{path}", sent=True)
    assert db.state == "ok" and db.read("t", parts=3).agg({"x": "sum"}).first()[0] == 1225
    assert sqlite.Database(spark, f"file://{tmp_path}/gone.db", sent=True).state == "missing"


def test_images_hold_all_types(spark):
    df = spark.sql("SELECT id, cast(id AS int) AS n, concat('t''', id) AS s, cast('b' AS binary) AS b, id / 4 AS d, cast(id AS decimal(5, 1)) AS e, array(cast(id AS float)) AS v, id % 2 = 0 AS g, IF(id < 3, NULL, 'x') AS o, date'2024-01-02' AS t FROM range(10)").repartition(2)
    images = sqlite.to_images(df, "t", rows=3)
    back = sqlite.read_images(images, "t", "id long, n long, s string, b binary, d double, e string, v array<float>, g boolean, o string, t string").drop("path")
    want = df.selectExpr("id", "cast(n AS long) n", "s", "b", "d", "cast(e AS string) e", "v", "g", "o", "cast(t AS string) t")
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect())) and images.count() >= 4
    assert sqlite.to_images(df.limit(0), "t").count() == 0


SCRIPT = """-- a comment; with 'quotes
CREATE TABLE t (a INTEGER, b TEXT); /* a block; 'of
lines' */
INSERT INTO t VALUES (1, 'it''s; -- not a comment'), (2, NULL),(-3.5e1, 'two
lines;
/* no comment */ "here"');
INSERT OR IGNORE INTO "t" ("b", a) VALUES ('semi;colon', 4) ;

INSERT INTO other VALUES (1, X'00ff', `y`);
;
INSERT INTO t(a,b) VALUES (5, '');  -- last
UPDATE t SET b = 'x;y' WHERE a = 1"""


def one_pass(text, backslash=False):
    out, now, state, i = [], "", None, 0
    while i < len(text):
        c = text[i]
        two = text[i : i + 2]
        if state is None:
            if c == ";":
                out.append(now + c)
                now, i = "", i + 1
                continue
            if two in ("--", "/*"):
                state, now, i = two, now + two, i + 2
                continue
            state = c if c in "'\"`" else None
        elif state == "--":
            state = None if c == "\n" else state
        elif state == "/*":
            if two == "*/":
                state, now, i = None, now + two, i + 2
                continue
        elif backslash and c == "\\" and state in "'\"":
            now, i = now + two, i + 2
            continue
        elif c == state:
            state = None
        now, i = now + c, i + 1
    out.append(now)
    bare = [re.sub(r"^(\s*(--[^\n]*(\n|$)|/\*.*?\*/))+", "", s.strip(), flags=re.S) for s in out]
    return [(i, s.strip()) for i, (s, b) in enumerate(zip(out, bare)) if b.strip(" \n;")]


@pytest.mark.parametrize("size", [16, 61, 1 << 20])
def test_a_script_cut_anywhere(spark, tmp_path, size):
    rng = random.Random(size)
    more = "".join(rng.choice(["'", "''", ";", "\n", "a", "--", "/*", "*/", '"', "`", " ", "é"]) for _ in range(3000)) + "\n*/'\"`\n"
    (tmp_path / "a.sql").write_text(SCRIPT)
    (tmp_path / "b.sql").write_text(more)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {}
        for r in dump.statements(spark, str(tmp_path)).collect():
            got.setdefault(r["file"][-5:], []).append((r["ordinal"], r["statement"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got["a.sql"]) == one_pass(SCRIPT)
    assert sorted(got["b.sql"]) == one_pass(more)


def test_rows_of_a_script(spark, tmp_path):
    (tmp_path / "a.sql").write_text(SCRIPT)
    script = dump.statements(spark, str(tmp_path / "a.sql"))
    got = {(r["a"], r["b"]) for r in dump.rows_of(script, "T", "a double, b string").collect()}
    assert got == {(1.0, "it's; -- not a comment"), (2.0, None), (-35.0, 'two\nlines;\n/* no comment */ "here"'), (4.0, "semi;colon"), (5.0, "")}
    assert [tuple(r) for r in dump.rows_of(script, "other", "n int, b binary, c string").collect()] == [(1, bytearray(b"\x00\xff"), "`y`")]
    (tmp_path / "m.sql").write_text("INSERT INTO t VALUES (1, 'a\\'b;\\n\\\\'), (2, 'x');\n")
    mine = dump.rows_of(dump.statements(spark, str(tmp_path / "m.sql"), backslash=True), "t", "a int, b string", backslash=True)
    assert {tuple(r) for r in mine.collect()} == {(1, "a'b;\n\\"), (2, "x")}
    (tmp_path / "e.sql").write_text("")
    assert dump.statements(spark, str(tmp_path / "e.sql")).count() == 0


def test_what_is_written_is_read(spark, tmp_path):
    df = spark.sql("SELECT id, IF(id = 2, NULL, concat('a''b;\n-- ', id)) AS s, id / 3 AS d, array(cast(id AS float), 0.5f) AS v, cast('é' AS binary) AS b, date'2024-01-02' AS t FROM range(20)")
    dump.written(df, "t").write.text(str(tmp_path / "t"))
    back = dump.rows_of(dump.statements(spark, str(tmp_path / "t")), "t", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_schema_texts_that_are_odd_and_ids_that_collide(spark):
    from quillon.sources import schemas

    table = '{"table_name": "T", "column_names": ["a"], "column_types": ["INT"], "column_descriptions": ["x"]}'
    nameless = '{"column_names": ["a"], "column_types": ["INT"], "column_descriptions": ["x"]}'
    whole = '{"tables": [%s, %s, null], "foreign_keys": [null, {"source_table": "t"}]}' % (table, nameless)
    rows = [(1, "A b", whole), (2, " a-B\t", whole), (3, "a_b", whole), (4, "a_b_2", whole), (5, None, whole), (6, "x", None), (7, "x", "[]"), (8, "x", '{"tables": 3, "foreign_keys": []}'), (9, "y" * 90, whole), (10, "y" * 80, whole), (11, "", whole)]
    df = spark.createDataFrame(rows, "id long, domain string, text string")
    got = {r["key"]: r for r in schemas.parsed_schemas(df, "text", "domain", "id").collect()}
    assert set(got) == {1, 2, 3, 4, 9, 10, 11}
    assert all([t["table_name"] for t in r["tables"]] == ["T"] and r["foreign_keys"] == [] for r in got.values())
    ids = {k: r["db_id"] for k, r in got.items()}
    assert (ids[1], ids[4], ids[9], ids[10], ids[11]) == ("a_b", "a_b_2", "y" * 75, "y" * 75 + "_2", "")
    assert ids[2] == "_a_b" and ids[3].startswith("a_b_2_") and len(ids[3]) == 18
    assert len(set(ids.values())) == len(ids)
    assert schemas.parsed_schemas(df.limit(0), "text", "domain", "id").count() == 0
    same = schemas.database_ids(df.withColumn("domain", F.lit("hot")), "domain", "id")
    assert sorted(r["db_id"] for r in same.collect()) == sorted(["hot", *(f"hot_{i}" for i in range(2, 12))])
