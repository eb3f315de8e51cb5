"""JSON, JSONL and CSV files of cases, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array per file, or an object per line."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=not lines)


def plain(df: DataFrame) -> DataFrame:
    """Values that JSON lacks as texts: dates in ISO form, decimals as they are written, binaries in base 64."""
    cast = {"binary": F.base64, "date": lambda c: c.cast("string"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")}
    return df.select(*[(F.col(c).cast("string") if t.startswith("decimal") else cast[t](F.col(c)) if t in cast else F.col(c)).alias(c) for c, t in df.dtypes])


def write_results(df: DataFrame, path: str, key: str = "query_id") -> None:
    """Sorted by key; written whole or not at all by Spark's commit."""
    plain(df).sort(key).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def missing_from_cache(cases: DataFrame, cache: DataFrame, key: str = "query_id") -> DataFrame:
    """Cases without a cached result that is free of errors."""
    return cases.join(cache.filter("error IS NULL").select(key), key, "left_anti")
