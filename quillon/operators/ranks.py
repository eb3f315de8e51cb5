"""Row numbers over whole tables and large keys, without a task that holds all rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task sorts, about, whatever the session's number of shuffle partitions.
ROWS = 1 << 19


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder. In local mode one of our own serves where the session names none; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """df as it is now, in the checkpoint folder: what reads it twice sees the same partitions."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as it is now, as Parquet in the checkpoint folder until the session's JVM ends: smaller than pinned, and of a size that the planner knows."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/ranks-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # of a path that exists
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """Adds ``name``: each row's place by ``order``, from ``start``; nulls first, ties in any order.

    Range partitions are numbered on their own and shifted by the sizes of those before,
    a row per partition. Range bounds come from samples, which differ from plan to plan, so the
    partitions are pinned before their sizes are taken.
    """
    ranged = pinned(df.repartitionByRange(F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if t in ("string", "binary", "int", "bigint", "double")] or [F.lit(0)])).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    sizes = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__o"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1 + start
    out = ranged.withColumn("__n", within).join(F.broadcast(sizes), "__p")
    return out.withColumn(name, F.col("__n") + F.col("__o")).drop("__p", "__n", "__o")


def placed(df: DataFrame, by: str, order: list[Column], weight: str | None = None) -> DataFrame:
    """Adds place, from 1 by ``order`` among the rows of the same ``by``, and rows, how many these are; with a weight also upto and total, its sums over the same rows.

    No task holds a key: rows are sorted over range partitions of ROWS rows or so, and counted on from the
    sizes of a key's partitions before, a row for each key and partition. Nulls are a key.
    """
    keys = [F.col(by), *order]
    ranged = df.repartitionByRange(max(1, -(-df.count() // ROWS)), *keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()))  # range bounds differ from plan to plan
    ranged = ranged.withColumn("__p", F.shiftright("__at", 33))  # an id's upper bits are its partition
    sums = {"rows": F.count("*")} | ({"total": F.sum(weight)} if weight else {})
    sizes = ranged.groupBy(by, "__p").agg(F.min("__at").alias("__first"), *[c.alias(name) for name, c in sums.items()])
    key = Window.partitionBy(by)
    before = [(F.sum(name).over(key.orderBy("__p")) - F.col(name)).alias(f"__{name}") for name in sums]
    sizes = written(sizes.select(F.col(by).alias("__by"), F.col("__p").alias("__q"), "__first", *before, *[F.sum(name).over(key).alias(name) for name in sums]))
    out = ranged.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__p") == F.col("__q")))
    added = [(F.col("__rows") + F.col("__at") - F.col("__first") + 1).alias("place")]
    if weight:
        added.append((F.col("__total") + F.sum(weight).over(Window.partitionBy(by, "__p").orderBy("__at"))).alias("upto"))
    return out.select(*df.columns, *added, *sums)


def ranked(df: DataFrame, by: str, order: list[Column], peer: str, tiles: int, digits: int) -> DataFrame:
    """Adds what SQL's ranking functions give over keys of any size, nulls of ``peer`` last.

    Within each ``by``, row_number and ntile go by ``order``, then by ``peer``; rank, dense_rank, percent_rank and
    cume_dist by ``peer``, whose values are counted and ranked once, shares rounded to ``digits``, and joined to the rows.
    """
    last = F.col(peer).asc_nulls_last()
    peers = written(df.groupBy(by, peer).agg(F.count("*").alias("__n")))
    peers = placed(peers, by, [last], "__n").withColumn("rank", F.col("upto") - F.col("__n") + 1)
    shares = {"percent_rank": (F.col("rank") - 1) / F.greatest(F.col("total") - 1, F.lit(1)), "cume_dist": F.col("upto") / F.col("total")}
    peers = peers.select(F.col(by).alias("__by"), F.col(peer).alias("__peer"), F.col("rank").cast("int"), F.col("place").cast("int").alias("dense_rank"), *[F.round(c, digits).alias(n) for n, c in shares.items()])
    out = placed(df, by, [*order, last]).join(written(peers), F.col(by).eqNullSafe(F.col("__by")) & F.col(peer).eqNullSafe(F.col("__peer")))
    each, more = f"(rows div {tiles})", f"(rows % {tiles})"  # rows of a tile; the first tiles have one more
    tile = f"CASE WHEN place <= {more} * ({each} + 1) THEN (place - 1) div ({each} + 1) ELSE (place - 1 - {more}) div greatest({each}, 1) END"
    own = [F.col("place").cast("int").alias("row_number"), F.expr(f"CAST({tile} + 1 AS INT)").alias("ntile")]
    return out.select(*df.columns, *own, "rank", "dense_rank", *shares)
