"""Keyed state with timers: the nearest rows of each group and window, and the first statements of each template.

Over tables both are ranks by window functions, in the JVM. Streams keep state by key with timers, give the same rows, and need the RocksDB state
store (``use_rocksdb``) and a checkpoint, from which a stopped stream goes on with the state it had. Rows without an event time are left
out; a stream also leaves out rows later than its watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.corpus import template
from ..operators.knn import with_distance


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers are kept by this provider only. Call it on a session of the stream's own where others use another one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(rows: DataFrame, time_col: str, late: str) -> DataFrame:
    """Adds __at with its watermark."""
    return rows.withColumn("__at", F.col(time_col).cast("timestamp")).filter("__at IS NOT NULL").withWatermark("__at", late)


class _Nearest(StatefulProcessor):
    """Keeps the k least (distance, key) of a group's window, and gives them when the window has passed."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "distance double, key long")

    def handleInputRows(self, key, rows, timerValues):
        held = pd.DataFrame(list(self.best.get()), columns=["distance", "key"]) if self.best.exists() else None
        end = None
        for batch in rows:
            end = batch["ends"].iloc[0]
            more = batch[["distance", "key"]]
            held = (more if held is None else pd.concat([held, more])).sort_values(["distance", "key"]).head(self.k)
        if end is not None:
            self.best.put([(float(d), int(i)) for d, i in held.itertuples(index=False)])
            self.handle.registerTimer(int(end))
        yield pd.DataFrame(columns=["group", "start", "key", "distance", "rank"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best = pd.DataFrame(list(self.best.get()), columns=["distance", "key"])
        best["group"], best["start"], best["rank"] = key[0], key[1], range(1, len(best) + 1)
        self.best.clear()
        yield best[["group", "start", "key", "distance", "rank"]]

    def close(self) -> None:
        pass


def _cut(k: int):
    """Of each Arrow batch the k nearest rows of a group's window. Rows left out don't move the watermark on, so windows close later at most."""

    def run(batches):
        for batch in batches:
            yield batch.sort_values(["distance", "key"]).groupby(["group", "start"], sort=False, dropna=False).head(k)

    return run


def nearest_by_window(rows: DataFrame, group: str, vec_col: str | None, query: Sequence[float] | Column | None, k: int, key: str, time_col: str, window: str = "1 hour", late: str = "2 hours", metric: str = "l2", distance: Column | None = None) -> DataFrame:
    """(group, start, key, distance, rank): of each group, the k rows of every window that are nearest to query, in a stream once the watermark has passed its end.

    distance takes the place of vec_col and query where what ranks the rows isn't a vector's distance. key is an integer column; ties go by it. Distances are
    computed in the JVM; tasks cut their batches to k rows a group and window before the shuffle, so a hot group sends k rows a
    batch, and state is k rows for each open window. Rows without a distance or a key have no part; a null group is a group.
    """
    near = with_distance(rows, vec_col, query, metric) if distance is None else rows.withColumn("distance", distance)
    at = F.col(time_col).cast("timestamp")
    near = near.select(F.col(group).alias("group"), F.window(at, window).alias("w"), F.col("distance").cast("double").alias("distance"), F.col(key).cast("long").alias("key"), at.alias("at"))
    near = near.filter("distance IS NOT NULL AND NOT isnan(distance) AND key IS NOT NULL AND at IS NOT NULL")
    if not rows.isStreaming:
        ranked = near.withColumn("start", F.col("w.start")).withColumn("rank", F.row_number().over(Window.partitionBy("group", "start").orderBy("distance", "key")))
        return ranked.filter(F.col("rank") <= k).select("group", "start", "key", "distance", "rank")
    near = near.select("group", F.col("w.start").alias("start"), F.unix_millis("w.end").alias("ends"), "distance", "key", "at")
    cut = _timed(near.mapInPandas(_cut(k), near.schema), "at", late).drop("at")
    kind = near.schema["group"].dataType
    out = T.StructType([T.StructField("group", kind), T.StructField("start", T.TimestampType()), T.StructField("key", T.LongType()), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return cut.groupBy("group", "start").transformWithStateInPandas(_Nearest(k), out, "Append", "eventTime")


class _FirstOfTemplate(StatefulProcessor):
    """Lets the first n statements of a template through, and forgets it when none came for a while."""

    def __init__(self, n: int, forget_ms: int):
        self.n, self.forget_ms = n, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, until long")

    def handleInputRows(self, key, rows, timerValues):
        n, until = self.seen.get() if self.seen.exists() else (0, None)
        every = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        due = max(int(every["ms"].max()) + self.forget_ms, until or 0)
        if due != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(due)
        first = every.head(max(0, self.n - n))
        self.seen.update((n + len(first), due))
        yield first[["id", "sql", "ms"]].assign(seen=range(n + 1, n + 1 + len(first)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        yield pd.DataFrame(columns=["id", "sql", "ms", "seen"])

    def close(self) -> None:
        pass


def first_of_template(rows: DataFrame, id_col: str, sql_col: str, time_col: str, n: int = 1, forget: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(id, sql, at, seen): the first n statements of each template, seen counting them; a stream forgets a template when its watermark is ``forget`` past the latest one.

    Statements of a table or of one batch are taken in order of time and id, batches as they come. A null statement has no template and is left out. Only templates' digests are keys,
    and state is two numbers each.
    """
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    timed = _timed(rows.filter(F.col(sql_col).isNotNull()), time_col, late)
    if not rows.isStreaming:
        ranked = timed.select(F.md5(template(F.col(sql_col))).alias("t"), F.col(id_col).cast("long").alias("id"), F.col(sql_col).alias("sql"), F.col("__at").alias("at"))
        ranked = ranked.withColumn("seen", F.row_number().over(Window.partitionBy("t").orderBy("at", "id")).cast("long"))
        return ranked.filter(F.col("seen") <= n).select("id", "sql", "at", "seen")
    kept = timed.select(F.md5(template(F.col(sql_col))).alias("t"), F.col(id_col).cast("long").alias("id"), F.col(sql_col).alias("sql"), F.unix_millis("__at").alias("ms"), "__at")
    out = kept.groupBy("t").transformWithStateInPandas(_FirstOfTemplate(n, forget_ms), "id long, sql string, ms long, seen long", "Append", "eventTime")
    return out.select("id", "sql", F.timestamp_millis("ms").alias("at"), "seen")
