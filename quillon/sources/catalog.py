"""Databases as directories of Parquet tables or external servers; their schemas and samples."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def normal_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", name).lower()


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(name, is a directory) of what a folder of any Hadoop file system holds; nothing if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in system.listStatus(at)) if system.exists(at) else []


def discover(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path of the Parquet files and directories in a folder."""
    return {normal_name(n.removesuffix(".parquet")): f"{folder.rstrip('/')}/{n}" for n, _ in _listed(spark, folder) if n.endswith(".parquet")}


def databases(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """Database (path below root, "" for root itself) -> its tables, for all folders below root that hold any."""
    out, todo = {}, [""]
    while todo:
        at = todo.pop()
        folder = f"{root.rstrip('/')}/{at}".rstrip("/")
        if tables := discover(spark, folder):
            out[at] = tables
        todo += [f"{at}/{n}".strip("/") for n, is_dir in _listed(spark, folder) if is_dir and not n.endswith(".parquet") and n[0] not in "._"]
    return out


def register(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Temp views of the named tables of a folder."""
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def jdbc(spark: SparkSession, url: str, table: str, timeout: int = 60, partition: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 8, **options) -> DataFrame:
    """A table of an external server; split by a numeric column where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("queryTimeout", timeout).options(**options)
    if partition:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def server_keys(spark: SparkSession, url: str, tables: list[str], **options) -> DataFrame:
    """(table_name, column_name, position, ref_table, ref_column) of a server's tables, as its driver tells: primary keys with their position, foreign keys with what they refer to.

    tables: names as the server keeps them. What comes to the driver is a row per key column.
    """
    jvm = spark.sparkContext._jvm
    props = jvm.java.util.Properties()
    for k, v in options.items():
        props.setProperty(k, str(v))
    rows, con = [], jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        about = con.getMetaData()
        for t in tables:
            found = about.getPrimaryKeys(None, None, t)
            while found.next():
                rows.append((t, found.getString("COLUMN_NAME"), int(found.getShort("KEY_SEQ")) - 1, None, None))
            found = about.getImportedKeys(None, None, t)
            while found.next():
                rows.append((t, found.getString("FKCOLUMN_NAME"), None, found.getString("PKTABLE_NAME"), found.getString("PKCOLUMN_NAME")))
    finally:
        con.close()
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, ref_table string, ref_column string")


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, mode: str = "append", **options) -> None:
    """Vectors are written as JSON texts, which servers without arrays take."""
    flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])
    flat.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


def describe(spark: SparkSession, tables: tuple[str, ...]) -> DataFrame:
    """(table_name, position, column_name, column_type, is_vector, base_column) of registered tables."""
    rows = []
    for t in tables:
        fields = spark.table(t).schema.fields
        names = {f.name for f in fields}
        for i, f in enumerate(fields):
            base = f.name.removesuffix("_embedding")
            vector = f.dataType.simpleString() in ("array<float>", "array<double>")
            rows.append((t, i, f.name, f.dataType.simpleString(), vector, base if vector and base != f.name and base in names else None))
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, column_type string, is_vector boolean, base_column string")


def shortened(df: DataFrame, width: int = 300) -> DataFrame:
    """df with long texts cut and marked."""
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
    return df.select(*[cut(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def sample(df: DataFrame, rows: int = 2, width: int = 300) -> DataFrame:
    """A few rows, with long texts cut and marked."""
    return shortened(df.limit(rows), width)


def column_values(df: DataFrame, columns: list[str], key: str, n: int = 2) -> DataFrame:
    """(column_name, key, value): the first n values by key of each column, nulls left out, for prompts that show what a column holds."""
    parts = [df.filter(F.col(f"`{c}`").isNotNull()).orderBy(key).limit(n).select(F.lit(c).alias("column_name"), F.col(key).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def is_empty(frames: list[DataFrame]) -> bool:
    """Whether every table of a database has no row."""
    return all(f.isEmpty() for f in frames)


def semantic_columns(df: DataFrame, least_length: float = 20.0, least_distinct: float = 0.3, skip: tuple[str, ...] = ("name", "address", "id", "url", "email", "phone")) -> DataFrame:
    """(column_name, avg_length, distinct_share, is_rich): text columns long and varied enough to embed.

    Distinct values are counted by their digests: what is shuffled is a digest for each
    distinct value of a column and task, and a frequent value folds before that.
    """
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, avg_length double, distinct_share double, is_rich boolean")
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.unhex(F.md5(F.col(f"`{c}`"))).alias("digest"), F.length(F.col(f"`{c}`")).alias("size")) for c in names])
    each = df.select(F.explode(values).alias("v")).groupBy("v.column_name", "v.digest").agg(F.count("*").alias("n"), F.first("v.size").cast("long").alias("size"))
    stats = each.groupBy("column_name").agg(F.sum("n").alias("rows"), F.count("digest").alias("distinct"), F.sum(F.col("n") * F.col("size")).alias("chars"), F.sum(F.when(F.col("digest").isNotNull(), F.col("n"))).alias("filled"))
    out = stats.select("column_name", F.round(F.col("chars") / F.col("filled"), 4).alias("avg_length"), F.round(F.col("distinct") / F.col("rows"), 4).alias("distinct_share"))
    named = ~F.lower("column_name").rlike("|".join(rf"(^|_){s}($|_)" for s in skip))
    return out.withColumn("is_rich", named & (F.col("avg_length") >= least_length) & (F.col("distinct_share") >= least_distinct))
