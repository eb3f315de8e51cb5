"""Text and image columns as vector columns, and the embedders that make them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A store of vectors by the digests of their texts.
STORE = "digest string, embedding array<float>"


class Embedder(Protocol):
    """Turns batches of texts into vectors of ``dim`` elements. Made in Python workers, by what ``vectorize`` is given."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signs of hashed words, scaled to length 1; deterministic, and no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0)


class TableEmbedder:
    """Vectors looked up by text, for statements whose few texts were embedded beforehand."""

    def __init__(self, known: dict[str, list[float]], dim: int):
        self.known, self.dim = known, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        missing = [t for t in texts if t not in self.known]
        if missing:
            raise KeyError(f"no vector for {missing[0]!r}")
        return np.array([self.known[t] for t in texts], np.float32).reshape(len(texts), self.dim)


@lru_cache(maxsize=4)
def model_of(make: Callable[[], Embedder]) -> Embedder:
    """The model of a class or function that can be imported is loaded once per Python worker; that of a closure, once per task."""
    return make()


def vectorize(df: DataFrame, columns: list[str], make: Callable[[], Embedder], batch: int = 128) -> DataFrame:
    """Adds <column>_embedding for each text column; null counts as empty. Works on streams as well.

    One Arrow pass carries the texts alone; tasks of a Python worker share an embedder, see model_of.
    """

    def column(name: str):
        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = model_of(make)
            for texts in batches:
                texts = texts.fillna("").tolist()
                parts = [model.embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
                yield pd.Series([v for p in parts for v in p], dtype=object)

        # a plan may repeat a deterministic call, above and below a filter say; a model runs once
        return embed.asNondeterministic()(F.col(name))

    return df.withColumns({f"{c}_embedding": column(c) for c in columns})


def vectorize_database(spark: SparkSession, tables: dict[str, str], columns: dict[str, list[str]], out: str, make: Callable[[], Embedder], threads: int = 4) -> DataFrame:
    """Writes each table of a database with its vector columns below out. Report: (table, status, rows, error).

    tables: name -> path; columns: name -> text columns to embed. Tables are written side by side. One that was written whole
    before, as its commit marker shows, is left as it is, so a run that broke off is resumed by running it again; where texts change, see ``remember``. A table that
    fails doesn't stop the others.
    """

    def one(name: str, path: str) -> tuple:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}.parquet/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return name, "present", spark.read.parquet(f"{out}/{name}.parquet").count(), None
        try:
            vectorize(spark.read.parquet(path), columns.get(name, []), make).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
            return name, "written", spark.read.parquet(f"{out}/{name}.parquet").count(), None
        except Exception as e:  # noqa: BLE001  reported; the other tables are tried
            return name, "failed", None, str(e).splitlines()[0]

    with ThreadPoolExecutor(threads) as pool:
        report = list(pool.map(lambda t: one(*t), sorted(tables.items())))
    return spark.createDataFrame(report, "table string, status string, rows long, error string")


def _text_id(column: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{column}`"), F.lit("")), 256)


def remember(rows: DataFrame, columns: list[str], store: str, make: Callable[[], Embedder], steps: int = 1) -> int:
    """Embeds those texts of the columns that a store lacks, and appends them; returns how many.

    The store is a table of (digest, embedding) at a path, for texts of any table: equal texts are embedded once, rows that
    didn't change not at all, and the store is only ever added to. With ``steps`` the texts are dealt by their digests and added a share at a time, so a
    run that breaks off loses one share at most.
    """
    spark = rows.sparkSession
    found = reduce(DataFrame.unionByName, [rows.select(_text_id(c).alias("digest"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("text")) for c in columns])
    added = 0
    for step in range(steps):
        todo = found.filter(F.pmod(F.xxhash64("digest"), F.lit(steps)) == step).groupBy("digest").agg(F.any_value("text").alias("text"))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        before = spark.read.schema(STORE).parquet(store).count() if exists else 0
        if exists:
            todo = todo.join(spark.read.schema(STORE).parquet(store).select("digest"), "digest", "left_anti")
        vectorize(todo, ["text"], make).select("digest", F.col("text_embedding").alias("embedding")).write.mode("append").parquet(store)
        added += spark.read.schema(STORE).parquet(store).count() - before
    return added


def with_vectors(rows: DataFrame, columns: list[str], store: str) -> DataFrame:
    """Adds <column>_embedding from a store; null where the store lacks a text."""
    known = rows.sparkSession.read.schema(STORE).parquet(store)
    for c in columns:
        mine = known.select(F.col("digest").alias("__d"), F.col("embedding").alias(f"{c}_embedding"))
        rows = rows.join(mine, _text_id(c) == F.col("__d"), "left").drop("__d")
    return rows


def vectorize_images(rows: DataFrame, path_col: str, images: str, make: Callable[[], object], spark: SparkSession) -> DataFrame:
    """Adds image_embedding from the files under ``images``; files that are missing or can't be read give zeros.

    make() gives an object with ``dim`` and ``embed_images(list[bytes])``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(images).select(F.element_at(F.split("path", "/"), -1).alias("__file"), "content")
    met = rows.join(files, F.element_at(F.split(F.col(path_col), "/"), -1) == F.col("__file"), "left").drop("__file")
    dim = make().dim

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_of(make)
        for contents in batches:
            out = []
            for c in contents:
                try:
                    out.append(np.asarray(model.embed_images([bytes(c)])[0], np.float32) if c is not None else None)
                except ValueError:
                    out.append(None)
            yield pd.Series([np.zeros(dim, np.float32) if v is None else v for v in out], dtype=object)

    return met.withColumn("image_embedding", embed("content")).drop("content")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats at rest as an array; bytes that make no whole float are cut."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def term_counts(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, bucket, n): hashed words of lower-cased texts, without Python."""
    words = F.explode(F.split(F.lower(F.col(text_col)), r"\s+"))
    rows = df.select(F.col(id_col).alias("id"), words.alias("word")).filter("word <> ''")
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dim
    return rows.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
