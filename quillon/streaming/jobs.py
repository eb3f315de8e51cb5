"""Vectorization, template dedup and windowed counts over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import template
from ..operators.vectorize import Embedder, vectorize


def vectorized(stream: DataFrame, columns: list[str], make: Callable[[], Embedder]) -> DataFrame:
    """A stateless map; the batch operator works unchanged."""
    return vectorize(stream, columns, make)


def first_templates(stream: DataFrame, sql_col: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Statements whose template wasn't seen within the watermark; state is bounded by it."""
    timed = stream.withColumn("__at", F.col(time_col).cast("timestamp")).withWatermark("__at", late).withColumn("__t", template(F.col(sql_col)))
    return timed.dropDuplicatesWithinWatermark(["__t"]).drop("__t", "__at")


def hourly(events: DataFrame, time_col: str = "ts", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by hour."""
    timed = events.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap."""
    timed = events.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def nearest_per_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], vec_col: str, query: list[float], k: int, key: str, checkpoint: str):
    """Top k of each micro-batch, given to sink with the batch's number; a cut over an unbounded stream has no other meaning."""
    from ..operators.knn import knn

    writer = stream.writeStream.foreachBatch(lambda df, n: sink(knn(df, vec_col, query, k, key), n))
    return writer.option("checkpointLocation", checkpoint).start()
