"""Shared folders, written tables and joins that survive hot keys."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts and bytes per Arrow batch at most: whole texts may be long.
ARROW_ROWS, ARROW_BYTES = 1024, 32 << 20
#: Keys holding more than one row in HEAVY_SHARE are handled by broadcast; there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode, where there is one machine, one of our own if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as they carry whole texts. Plans read these settings when they run, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


class BucketedTable:
    """A Parquet table at a path, bucketed and sorted by a key, that outlives its session.

    Its definition lies beside its rows. The default catalog forgets tables with their session, so a later
    one declares the table anew over the files that are there. The path must be one that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._system = self._at.getFileSystem(conf)
        if not self._system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/definition/_SUCCESS")):
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/definition")
        self.buckets = spark.read.parquet(f"{self.path}/definition").first()[0]
        self._system.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows"))
        self.name = f"bucketed_{hashlib.md5(self.path.encode()).hexdigest()}"
        where = f"{self.path}/rows".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """rows: dealt and sorted as the table is."""
        rows.select(*self.table().columns).write.insertInto(self.name)

    def drop(self) -> None:
        """Removes the files too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._system.delete(self._at, True)


def splits(rows: int, per_split: int = 10_000, least: int = 64) -> int:
    """Into how many hash splits a key is dealt so that no split of it grows beyond about per_split rows."""
    return max(least, -(-rows // per_split))


def split_of(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("split"), *cols), F.lit(n))


def join_grouped(rows: DataFrame, groups: DataFrame, key: str, n_col: str, total: int, spread: list[str]) -> DataFrame:
    """Left-join each row to its group's row, whatever share of the rows one group has.

    groups: unique by key, n_col its number of rows, total their sum. Groups above
    total / HEAVY_SHARE rows number fewer than HEAVY_SHARE, so they are broadcast;
    their rows get scattered keys and take no part in the sort-merge join.
    """
    value = [c for c in groups.columns if c != key]
    heavy = groups.filter(F.col(n_col) * HEAVY_SHARE > total).select(F.col(key).alias("__hk"), F.struct(*value).alias("__hv"))
    rest = groups.filter(F.col(n_col) * HEAVY_SHARE <= total).select(F.col(key).alias("__rk"), F.struct(*value).alias("__rv"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    # a scattered key that happens to be a real one does no harm: the heavy value comes first, and keys are unique
    scatter = F.xxhash64(F.lit("scatter"), *spread)
    kind = dict(groups.dtypes)[key]
    scatter = scatter if kind == "bigint" else scatter.cast("string").cast(kind)
    out = out.withColumn("__k", F.when(F.col("__hk").isNull(), F.col(key)).otherwise(scatter))
    out = out.join(rest, F.col("__k") == F.col("__rk"), "left")
    out = out.withColumn("__v", F.coalesce("__hv", "__rv"))
    return out.select(*rows.columns, *[F.col("__v")[c].alias(c) for c in value])
