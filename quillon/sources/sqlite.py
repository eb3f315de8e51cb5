"""SQLite database files as a source and a sink.

One large file is read by ranges of rowid, a task for each (``Database.read``). Many files
below a folder, or database images in a binary column, are read a file to a task (``read_all``, ``read_images``),
from any file system that Spark reads. ``to_images`` writes a table as images, one for each partition.

SQLite types values, not columns: a value that doesn't fit the declared type of its column is converted where
that loses nothing, and else null. Files that are missing, empty or damaged have a state instead of tables; reading
a table of theirs raises an error, or gives no rows where many files are read.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .schemas import spark_type

#: Bytes of a file for each task that reads it, and rows of an Arrow batch.
SPLIT, BATCH = 32 << 20, 4096
#: Endings of database files, and those of the tables in which a vector table keeps its parts.
ENDINGS = ("db", "sqlite", "sqlite3")
SHADOWS = ("_info", "_chunks", "_rowids", "_metadatatext", "_vector_chunks")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _whole(x: Any) -> int | None:
    n = int(x) if not isinstance(x, bytes) else int(x.decode())
    return n if -(1 << 63) <= n < 1 << 63 and (not isinstance(x, float) or n == x) else None


def _vector(x: Any) -> list[float] | None:
    if isinstance(x, bytes):
        return np.frombuffer(x[: len(x) // 4 * 4], "<f4").tolist()
    return [float(v) for v in json.loads(x)] if isinstance(x, str) else None


#: By Spark type: a value as that type; a ValueError or TypeError means that it is none.
CONVERT = {
    "bigint": _whole,
    "double": lambda x: float(x) if not isinstance(x, bytes) else float(x.decode()),
    "string": lambda x: x if isinstance(x, str) else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x),
    "binary": lambda x: x if isinstance(x, bytes) else str(x).encode(),
    "boolean": lambda x: {"true": True, "false": False}[x.lower()] if isinstance(x, str) and not x.isdigit() else bool(int(x)),
    "array<float>": _vector,
    "decimal(38,6)": lambda x: Decimal(str(x)).quantize(Decimal("0.000001")),
    "date": lambda x: date.fromisoformat(x[:10]),
    "timestamp": datetime.fromisoformat,
}


def _batches(cursor: sqlite3.Cursor, schema: T.StructType, lead: list[Any] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a cursor as Arrow batches of schema; lead: values of the columns before those of the cursor."""
    arrow, lead = to_arrow_schema(schema), lead or []
    kinds = [f.dataType.simpleString() for f in schema.fields][len(lead) :]

    def value(x: Any, kind: str) -> Any:
        try:
            return None if x is None else CONVERT[kind](x)
        except (ValueError, TypeError, KeyError, OverflowError, InvalidOperation, AttributeError):
            return None

    while rows := cursor.fetchmany(BATCH):
        columns = [[v] * len(rows) for v in lead] + [[value(r[i], k) for r in rows] for i, k in enumerate(kinds)]
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)


def _opened(at: str | bytes) -> sqlite3.Connection:
    """A connection that only reads: to a file, or to an image."""
    if isinstance(at, str):
        con = sqlite3.connect(f"file:{at.replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)
    else:
        con = sqlite3.connect(":memory:")
        if at:
            con.deserialize(at)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


@dataclass
class Table:
    schema: T.StructType
    primary: list[str] = field(default_factory=list)
    foreign: list[tuple[str, str, str]] = field(default_factory=list)
    #: Least and largest rowid; None where there is no rowid, as in views and some tables, which one task reads.
    rows: tuple[int, int] | None = None


def _tables(con: sqlite3.Connection) -> dict[str, Table]:
    listed = con.execute("SELECT name, type, coalesce(sql, '') FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall()
    virtual = {n for n, _, sql in listed if re.match(r"\s*CREATE\s+VIRTUAL", sql, re.I)}
    out = {}
    for name, kind, _ in listed:
        if name in virtual or any(name.startswith(v + s) for v in virtual for s in SHADOWS):
            continue
        columns = con.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
        found = [T.StructField(c[1], spark_type(c[2] or "")) for c in columns]
        keys = [c[1] for c in sorted((c for c in columns if c[5]), key=lambda c: c[5])]
        links = con.execute(f"PRAGMA foreign_key_list({quoted(name)})").fetchall()
        foreign = [(mine, theirs, other) for _, _, theirs, mine, other, *_ in sorted(links)]
        bounds = None
        if kind == "table":
            try:
                bounds = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(name)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID
                bounds = None
        out[name] = Table(T.StructType(found), keys, foreign, (0, -1) if bounds == (None, None) else bounds)
    # a reference that names no column means the other table's key
    for t in out.values():
        t.foreign = [(a, b, c or (out[b].primary or [None])[0] if b in out else c) for a, b, c in t.foreign]
    return out


def described(at: str | bytes) -> tuple[str, dict[str, Table]]:
    """(state, tables) of a file or an image; the state is ok, missing, empty or corrupt."""
    if isinstance(at, str) and not os.path.exists(at):
        return "missing", {}
    if (os.path.getsize(at) if isinstance(at, str) else len(at)) == 0:
        return "empty", {}
    try:
        con = _opened(at)
        try:
            return "ok", _tables(con)
        finally:
            con.close()
    except sqlite3.DatabaseError:
        return "corrupt", {}


class RowRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[RowRange]:
        if "low" not in self.options:
            return [RowRange(None, None)]
        low, high, parts = (int(self.options[k]) for k in ("low", "high", "parts"))
        if high < low:
            return []
        step = -(-(high - low + 1) // max(1, parts))
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without rows
            return
        at = SparkFiles.get(self.options["file"]) if self.options["sent"] == "true" else self.options["file"]
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        con = _opened(at)
        try:
            where = "" if partition.low is None else f" WHERE rowid BETWEEN {partition.low} AND {partition.high}"
            yield from _batches(con.execute(f"SELECT {names} FROM {quoted(self.options['from'])}{where}"), self.schema)
        finally:
            con.close()


class SqliteSource(DataSource):
    """Rows of one table of a file; ``Database.read`` sets its options."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


class Database:
    """One database file. path: one that all nodes can open, or, with sent, one of any file system, which Spark sends to each executor once.

    Files that are sent must differ in name.
    """

    def __init__(self, spark: SparkSession, path: str, sent: bool = False):
        self.spark, self.path, self.sent = spark, path, sent
        self.local = path.removeprefix("file://")
        if sent:
            self.local = ""
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                spark.sparkContext.addFile(path)
                self.local = SparkFiles.get(os.path.basename(path))
        self.state, self.tables = described(self.local) if self.local else ("missing", {})

    def read(self, table: str, parts: int | None = None) -> DataFrame:
        if self.state != "ok" or table not in self.tables:
            raise ValueError(f"{self.path} is {self.state}" if self.state != "ok" else f"{self.path} has no table {table}")
        self.spark.dataSource.register(SqliteSource)
        found = self.tables[table]
        reader = self.spark.read.format("sqlite_rows").schema(found.schema).option("from", table).option("sent", str(self.sent).lower())
        reader = reader.option("file", os.path.basename(self.path) if self.sent else self.local)
        if found.rows:
            reader = reader.option("low", found.rows[0]).option("high", found.rows[1]).option("parts", parts or max(1, -(-os.path.getsize(self.local) // SPLIT)))
        return reader.load()

    def is_empty(self) -> bool:
        """Whether no table has a row; so are files that are missing, empty or damaged."""
        if self.state != "ok":
            return True
        con = _opened(self.local)
        try:
            return all(con.execute(f"SELECT NOT EXISTS (SELECT 1 FROM {quoted(t)})").fetchone()[0] for t in self.tables)
        except sqlite3.DatabaseError:
            return True
        finally:
            con.close()

    def keys(self) -> DataFrame:
        """(table_name, column_name, position, ref_table, ref_column): primary keys with their position, foreign keys with what they refer to."""
        rows = [(n, c, i, None, None) for n, t in self.tables.items() for i, c in enumerate(t.primary)]
        rows += [(n, a, None, b, c) for n, t in self.tables.items() for a, b, c in t.foreign]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, position int, ref_table string, ref_column string")


def images_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the database files below a folder. Files without a byte are none to Spark; ``Database`` tells them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(root)
    return files.select("path", "content")


def inventory(images: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, state, table_name, rows, columns): a row per table of each image, and one for each image without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state, tables = described(content or b"")
                counts = {}
                if tables:
                    con = _opened(content)
                    try:
                        counts = {t: con.execute(f"SELECT count(*) FROM {quoted(t)}").fetchone()[0] for t in tables}
                    except sqlite3.DatabaseError:
                        state, tables = "corrupt", {}
                    con.close()
                out += [(path, state, t, counts[t], tables[t].schema.names) for t in tables] or [(path, state, None, None, None)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["path", "state", "table_name", "rows", "columns"])

    return images.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, state string, table_name string, rows long, columns array<string>")


def read_images(images: DataFrame, table: str, schema: T.StructType | str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path and the columns of schema, from a table of each image; images without that table, or without one of its columns, give no rows."""
    found = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = T.StructType([T.StructField("path", T.StringType()), *found.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ", ".join(quoted(n) for n in found.names)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state, tables = described(content or b"")
                if state == "ok" and table in tables and set(found.names) <= set(tables[table].schema.names):
                    con = _opened(content)
                    yield from _batches(con.execute(f"SELECT {names} FROM {quoted(table)}"), out, [path])
                    con.close()

    return images.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, out)


def read_all(spark: SparkSession, root: str, table: str, schema: T.StructType | str) -> DataFrame:
    """A table of every database file below a folder."""
    return read_images(images_below(spark, root), table, schema)


#: Declared types of the columns written.
DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT", "binary": "BLOB", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}


def to_images(df: DataFrame, table: str, rows: int = 100_000) -> DataFrame:
    """(path, content): df as database images of so many rows at most, made where its partitions lie. Vectors are stored as 32-bit floats, other types without an equal as texts."""
    kinds = dict(df.dtypes)
    vectors = {c for c, t in kinds.items() if t in ("array<float>", "array<double>")}
    plain = df.select(*[F.col(f"`{c}`") if c in vectors or t in DECLARED else F.col(f"`{c}`").cast("string").alias(c) for c, t in kinds.items()])
    names, most = df.columns, rows

    def declared(c: str) -> str:
        return "float[]" if c in vectors else DECLARED.get(kinds[c], "TEXT")

    def stored(c: str, v: Any) -> Any:
        return np.asarray(v, "<f4").tobytes() if c in vectors and v is not None else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, con, held = TaskContext.get().partitionId(), 0, None, 0

        def image() -> pa.RecordBatch:
            con.commit()
            return pa.record_batch([pa.array([f"{table}-{part:05d}-{made:05d}"]), pa.array([con.serialize()], pa.binary())], names=["path", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if con is None:
                    con, held = sqlite3.connect(":memory:"), 0
                    con.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(c)} {declared(c)}' for c in names)})")
                con.execute(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", [stored(c, v) for c, v in zip(names, row)])
                held += 1
                if held >= most:
                    yield image()
                    con, made = None, made + 1
        if con is not None:
            yield image()

    return plain.mapInArrow(run, "path string, content binary")
