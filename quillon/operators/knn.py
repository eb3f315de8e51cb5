"""Nearest neighbours: exact top-k, radius and joins, and an inverted-file index."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import DISTANCES, vector
from .knn_join import knn_join

__all__ = ["VectorIndex", "knn", "knn_join", "knn_of", "medoids", "top_per_group", "with_distance", "within"]

#: Groups whose sums a task holds before it passes them on.
GROUPS_HELD = 4096


def with_distance(df: DataFrame, vec_col: str, query: Sequence[float] | Column, metric: str = "l2") -> DataFrame:
    """Adds column distance."""
    q = query if isinstance(query, Column) else vector(query)
    return df.withColumn("distance", DISTANCES[metric](F.col(vec_col), q))


def knn(df: DataFrame, vec_col: str, query: Sequence[float] | Column, k: int, key: str, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k rows nearest to query, with their distance; ties by key. ``where`` applies before the cut.

    Plans to TakeOrderedAndProject: each task keeps k rows.
    """
    rows = df if where is None else df.filter(where)
    return with_distance(rows, vec_col, query, metric).filter("distance IS NOT NULL").orderBy("distance", key).limit(k)


def knn_of(df: DataFrame, vec_col: str, hits: DataFrame, k: int, key: str, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k rows nearest to the vector of ``hits``, a frame of one column and one row at most, such as an earlier search's best; none if it is empty.

    The one row is broadcast within the plan, so the searches are one job and nothing comes to the driver.
    """
    one = hits.limit(1).toDF("__query")
    return knn(df.crossJoin(F.broadcast(one)), vec_col, F.col("__query"), k, key, metric, where).drop("__query")


def within(df: DataFrame, vec_col: str, query: Sequence[float] | Column, radius: float, metric: str = "l2") -> DataFrame:
    """Rows nearer than radius."""
    return with_distance(df, vec_col, query, metric).filter(F.col("distance") < radius)


def top_per_group(df: DataFrame, group: str, k: int, order: str, key: str) -> DataFrame:
    """The k rows of least order in each group; plans to a partial and a final WindowGroupLimit."""
    w = Window.partitionBy(group).orderBy(order, key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    dot = a @ b.T
    if metric == "ip":
        return -dot
    x, y = (a * a).sum(1), (b * b).sum(1)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - dot / np.sqrt(x[:, None] * y[None, :])
        return np.where(np.isfinite(d), d, np.inf)
    return np.sqrt(np.maximum(x[:, None] + y[None, :] - 2 * dot, 0))


def medoids(df: DataFrame, group: str, key: str, vec_col: str) -> DataFrame:
    """(group, key, total): in each group the row with the least sum of cosine distances to its group.

    The sum over a group of 1 - <u, v> for unit vectors is n - <u, sum of v>, so one
    mean vector per group does instead of all pairs. Tasks fold the vectors of a batch first. Vectors
    that are null, zero or hold null or non-finite elements have no part, nor have rows without a group.
    """
    size = F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = F.transform(F.col(vec_col), lambda x: F.try_divide(x.cast("double"), size))
    rows = df.select(F.col(group).alias("group"), F.col(key).alias("key"), unit.alias("u")).filter(F.col("group").isNotNull() & F.forall("u", lambda x: F.coalesce(F.abs(x) <= 1.5, F.lit(False))))

    def fold(batches):
        held = {}
        for batch in batches:
            if not len(batch):
                continue
            code, groups = pd.factorize(batch["group"])
            total = np.zeros((len(groups), len(batch["s"].iloc[0])))
            np.add.at(total, code, np.stack(batch["s"].to_numpy()))
            for g, s in zip(groups, total):
                held[g] = held[g] + s if g in held else s
            if len(held) > GROUPS_HELD:
                yield pd.DataFrame({"group": list(held), "s": list(held.values())})
                held = {}
        if held:
            yield pd.DataFrame({"group": list(held), "s": list(held.values())})

    # a vector for each task and group is what is shuffled; sorted, they are added up group by group
    schema = f"group {dict(df.dtypes)[group]}, s array<double>"
    partial = rows.select("group", F.col("u").alias("s")).mapInPandas(fold, schema)
    sums = partial.repartition("group").sortWithinPartitions("group").mapInPandas(_added, schema).withColumnRenamed("s", "sum")
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    total = F.col("n") - F.aggregate(F.zip_with("u", "sum", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scored = rows.join(sums, "group").join(counts, "group").select("group", "key", F.round(total, 6).alias("total"))
    least = scored.groupBy("group").agg(F.min(F.struct("total", "key")).alias("m"))
    return least.select("group", "m.key", "m.total")


def _added(batches):
    """One sum of vectors for each group, from rows sorted by group."""
    held, total = None, None
    for batch in batches:
        out = []
        for g, s in zip(batch["group"], batch["s"]):
            if total is not None and g == held:
                total = total + s
                continue
            if total is not None:
                out.append((held, total))
            held, total = g, s
        yield pd.DataFrame(out, columns=["group", "s"])
    if total is not None:
        yield pd.DataFrame([(held, total)], columns=["group", "s"])


class VectorIndex:
    """Inverted file with residual codes: a search estimates distances from the codes of the nearest lists and reads few rows in full.

    A row's code is what is left of it beyond its list's centroid, four bits a component and a scale, an
    eighth of the vector. ``search`` takes the rows of the least estimates, reads those alone (their keys are pushed to the scan) and ranks
    them by their true distances. Centroids are fitted on a bounded sample; every row is indexed. How many lists a
    search reads, and how many rows in full, follows from the recall measured on the finished index against exact search.
    A code's error, how far it is from its row, tells which rows an exact search has to read besides.
    """

    SAMPLE = 20_000
    #: Share of the true neighbours that the lists read must hold, and that the rows taken from their codes must hold; the k measured for; the queries that measure, at most.
    RECALL, KEPT, MEASURED, QUERIES = 0.95, 0.98, (10, 100), 256
    #: Rows taken for each neighbour asked for, at most; what is measured decides.
    WIDEST = 8
    #: Codes that meet a block of queries at once in ``search_all``.
    DEALT = 16_384
    #: Keys that an exact search broadcasts, at most.
    BROADCAST = 200_000

    def __init__(self, path: str, key: str, centroids: np.ndarray, measured: Sequence[tuple[int, int, int, float]] = ()):
        self.path, self.key, self.centroids, self.measured = path, key, centroids, sorted(measured)

    @classmethod
    def build(cls, df: DataFrame, key: str, vec_col: str, path: str, lists: int | None = None, rounds: int = 10, rebuild: bool = False, queries: Column | None = None) -> VectorIndex:
        """queries: the rows whose neighbours measure the recall, by default all; above QUERIES, those first in hash order."""
        spark = df.sparkSession
        where = f"{path}/centroids"
        if not rebuild and _exists(spark, where):
            return cls(path, key, cls._read(spark, where))._measure(spark, vec_col, queries, again=False)
        finite = F.forall(vec_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is the largest number
        sample = df.filter(F.col(vec_col).isNotNull() & finite).orderBy(F.xxhash64(vec_col)).limit(cls.SAMPLE).select(vec_col).toPandas()[vec_col]
        x = np.stack(sample.to_numpy()).astype(float)
        n = min(lists or max(1, int(np.sqrt(len(x)))), len(x))
        c = x[np.linspace(0, len(x) - 1, n).astype(int)]
        for _ in range(rounds):
            owner = _distances(x, c, "l2").argmin(1)
            c = np.stack([x[owner == i].mean(0) if (owner == i).any() else c[i] for i in range(n)])
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "i int, v array<double>").write.mode("overwrite").parquet(where)

        @F.pandas_udf("int")
        def owner(v: pd.Series) -> pd.Series:
            return pd.Series(_distances(np.stack(v.to_numpy()).astype(float), c, "l2").argmin(1) if len(v) else [], dtype="int32")

        @F.pandas_udf("code binary, scale double, error double")
        def coded(v: pd.Series, owner: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"code": [], "scale": [], "error": []})
            have, center = np.stack(v.to_numpy()).astype(float), c[owner.to_numpy()]
            code, scale = _encode(have - center)
            return pd.DataFrame({"code": code, "scale": scale, "error": _apart(have, center + _decode(code, scale, have.shape[1]))})

        # a hot list is dealt to several files by a salt; sorted by key, so that a scan for a few keys skips most pages
        rows = df.filter(F.col(vec_col).isNotNull()).withColumn("centroid", owner(vec_col))
        dealt = rows.repartition("centroid", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(4))).sortWithinPartitions("centroid", key)
        dealt.write.mode("overwrite").option("parquet.page.row.count.limit", 512).partitionBy("centroid").parquet(f"{path}/rows")
        # codes come from the rows as written: a row between two lists has its code in the same one
        codes = spark.read.parquet(f"{path}/rows").select(F.col(f"`{key}`").alias("key"), "centroid", coded(vec_col, "centroid").alias("c")).select("key", "centroid", "c.*")
        codes.write.mode("overwrite").partitionBy("centroid").parquet(f"{path}/codes")
        return cls(path, key, c)._measure(spark, vec_col, queries, again=True)

    def _measure(self, spark, vec_col: str, queries: Column | None, again: bool) -> VectorIndex:
        """Sets measured to (k, probes, taken, recall).

        If only some of the queries are compared, two standard errors are taken off what they find.
        """
        where = f"{self.path}/measured"
        if not again and _exists(spark, where):
            self.measured = sorted(tuple(r) for r in spark.read.parquet(where).select("k", "probes", "taken", "recall").collect())
            return self
        rows = spark.read.parquet(f"{self.path}/rows")
        asked = rows if queries is None else rows.filter(queries)
        held = asked.select(vec_col).orderBy(F.xxhash64(vec_col)).limit(self.QUERIES + 1).toPandas()[vec_col]
        n, lists, most = min(len(held), self.QUERIES), len(self.centroids), max(self.MEASURED) + 1
        measured = []
        if n:
            wanted, centroids, width = np.stack(held.to_numpy()[:n]).astype(float), self.centroids, most * self.WIDEST
            place = np.argsort(np.argsort(_distances(wanted, centroids, "l2"), axis=1), axis=1).astype(np.int32)

            def nearest(batches):
                # for each query its nearest rows, and those of the least estimates: (distance, list's place, estimate)
                best = {"true": np.full((3, n, most), np.inf), "guess": np.full((3, n, width), np.inf)}
                for batch in batches:
                    if not len(batch):
                        continue
                    have, owner = np.stack(batch["v"].to_numpy()).astype(float), batch["centroid"].to_numpy()
                    back = centroids[owner] + _decode(*_encode(have - centroids[owner]), have.shape[1])
                    new = np.stack((_distances(wanted, have, "l2"), place[:, owner], _distances(wanted, back, "l2")))
                    for name, by in (("true", 0), ("guess", 2)):
                        both = np.concatenate((best[name], new), axis=2)
                        size = best[name].shape[2]
                        keep = np.argpartition(both[by], size - 1, axis=1)[:, :size]
                        best[name] = np.stack([np.take_along_axis(x, keep, 1) for x in both])
                for name in best:
                    q, j = np.nonzero(np.isfinite(best[name][0]))
                    yield pd.DataFrame({"kind": name, "q": q, "d": best[name][0][q, j], "place": best[name][1][q, j], "guess": best[name][2][q, j]})

            found = rows.select(F.col(vec_col).alias("v"), "centroid").mapInPandas(nearest, "kind string, q long, d double, place double, guess double")
            w = Window.partitionBy("kind", "q").orderBy(F.when(F.col("kind") == "true", F.col("d")).otherwise(F.col("guess")), "d", "place")
            # the first true one is the query's own row, or one equal to it
            found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.when(F.col("kind") == "true", most).otherwise(width)).toPandas()
            true, guess = (found[found["kind"] == name] for name in ("true", "guess"))
            for k in self.MEASURED:
                hits = true[(true["rank"] > 1) & (true["rank"] <= k + 1)]
                share = np.zeros((n, lists))
                np.add.at(share, (hits["q"].to_numpy(), hits["place"].to_numpy().astype(int)), 1)
                share = share[share.sum(1) > 0]
                if not len(share):
                    continue
                share = share.cumsum(1) / share.sum(1, keepdims=True)
                off = 2 * share.std(0) / np.sqrt(len(share)) if len(held) > n else 0
                probes = int(np.argmax(share.mean(0) - off >= self.RECALL)) + 1
                far = hits.groupby("q")["d"].max()
                inside = guess[guess["d"] <= guess["q"].map(far)]
                taken = next((m * k for m in range(1, self.WIDEST + 1) if (inside[inside["rank"] <= m * k + 1].groupby("q").size() / inside.groupby("q").size()).fillna(0).mean() >= self.KEPT), self.WIDEST * k)
                measured.append((k, probes, taken + 1, float(share.mean(0)[probes - 1])))
        spark.createDataFrame(measured, "k int, probes int, taken int, recall double").write.mode("overwrite").parquet(where)
        self.measured = measured
        return self

    def probes_for(self, k: int) -> int:
        """Lists that a search for k rows reads: as measured for the next larger k, or all."""
        return next((probes for measured, probes, *_ in self.measured if measured >= k), len(self.centroids))

    def taken_for(self, k: int) -> int:
        """Rows that a search for k rows reads in full."""
        return next((-(-taken * k // measured) for measured, _, taken, _ in self.measured if measured >= k), self.WIDEST * k)

    @staticmethod
    def _read(spark, where: str) -> np.ndarray:
        return np.stack(spark.read.parquet(where).orderBy("i").toPandas()["v"].to_numpy())

    def search(self, spark, vec_col: str, query: Sequence[float], k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """The k rows nearest to query, with their distance. What comes to the driver in between is ``taken_for(k)`` keys.

        exact: the k rows so found bound how far the nearest can be, and every row of any list that its code doesn't place farther is
        read in full. The result is that of ``knn``, ties too. k distances and a count per list come to the driver besides.
        """
        wanted, centroids, taken = np.asarray([query], np.float32).astype(float), self.centroids, self.taken_for(k)  # as vector() has it
        near = np.argsort(_distances(wanted, centroids, "l2")[0])[: self.probes_for(k) if probes is None else probes]

        def guess(batches):
            for batch in batches:
                if len(batch):
                    back = centroids[batch["centroid"].to_numpy()] + _decode(batch["code"], batch["scale"], wanted.shape[1])
                    d = _distances(wanted, back, "l2")[0]
                    first = np.argsort(d, kind="stable")[:taken]
                    yield batch.iloc[first][["key", "centroid"]].assign(guess=d[first])

        codes = spark.read.parquet(f"{self.path}/codes").filter(F.col("centroid").isin(near.tolist()))
        rows = spark.read.parquet(f"{self.path}/rows")
        kind = dict(codes.dtypes)["key"]
        best = codes.mapInPandas(guess, f"key {kind}, centroid int, guess double").orderBy("guess", "key").limit(taken).collect()
        few = rows.filter(F.col("centroid").isin(sorted({r["centroid"] for r in best})) & F.col(f"`{self.key}`").isin([r["key"] for r in best]))
        found = knn(few.drop("centroid"), vec_col, query, k, self.key)
        return knn(self._possible(spark, wanted, found, k), vec_col, query, k, self.key) if exact else found

    def _possible(self, spark, wanted: np.ndarray, found: DataFrame, k: int) -> DataFrame:
        """The rows that may be as near as the k found: those whose code is no farther than the last of these and the code's own error."""
        distances, centroids = [r["distance"] for r in found.select("distance").collect()], self.centroids
        bound = distances[-1] if len(distances) == k else float("inf")

        @F.pandas_udf("boolean")
        def near(code: pd.Series, scale: pd.Series, error: pd.Series, centroid: pd.Series) -> pd.Series:
            if not len(code):
                return pd.Series([], dtype=bool)
            guess = _apart(wanted, centroids[centroid.to_numpy()] + _decode(code, scale, wanted.shape[1]))
            with np.errstate(invalid="ignore"):
                # rounding may neither rule out a row, nor may what isn't a number
                return pd.Series(~((guess - error) - 1e-9 * (guess + error) > bound))

        left = spark.read.parquet(f"{self.path}/codes").filter(near("code", "scale", "error", "centroid")).select(F.col("key").alias("__key"), F.col("centroid").alias("__list"))
        sizes = left.groupBy("__list").count().collect()  # a row per list
        rows = spark.read.parquet(f"{self.path}/rows").filter(F.col("centroid").isin([r["__list"] for r in sizes]))
        left = F.broadcast(left) if sum(r["count"] for r in sizes) <= self.BROADCAST else left
        return rows.join(left, (F.col("centroid") == F.col("__list")) & F.col(f"`{self.key}`").eqNullSafe(F.col("__key")), "left_semi").drop("centroid")

    def search_all(self, queries: DataFrame, key: str, vec_col: str, k: int) -> DataFrame:
        """(query_key, key, distance, rank) for a table of queries: each goes to its lists' codes, and the rows taken from them are measured in full.

        A list's codes are dealt to parts of bounded size by a salt, and so are a list's queries.
        """
        spark, centroids, probes, taken = queries.sparkSession, self.centroids, self.probes_for(k), self.taken_for(k)
        kind, mine = dict(queries.dtypes)[key], dict(spark.read.parquet(f"{self.path}/codes").dtypes)["key"]
        asked = queries.filter(F.col(vec_col).isNotNull()).select(F.col(key).alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
        codes = spark.read.parquet(f"{self.path}/codes")

        def route(batches):
            for batch in batches:
                d = _distances(np.stack(batch["v"].to_numpy()), centroids, "l2") if len(batch) else np.empty((0, 1))
                yield batch.assign(lists=list(np.argsort(d, axis=1)[:, :probes].astype(np.int32)))

        def guess(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"q": [], "key": [], "guess": []})
            wanted = np.stack(q["v"].to_numpy())
            d = _distances(wanted, centroids[c["centroid"].to_numpy()] + _decode(c["code"], c["scale"], wanted.shape[1]), "l2")
            m = min(taken, d.shape[1])
            first = np.argpartition(d, m - 1, axis=1)[:, :m]
            return pd.DataFrame({"q": np.repeat(q["q"].to_numpy(), m), "key": c["key"].to_numpy()[first].ravel(), "guess": np.take_along_axis(d, first, 1).ravel()})

        sizes = codes.groupBy("centroid").count().collect()  # a row per list
        parts = np.ones(len(centroids), int)
        for c, size in sizes:
            parts[c] = -(-size // self.DEALT)
        many = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("centroid") + 1)
        # queries are dealt to as many salts as hold DEALT of them; each salt meets all parts of its lists
        salts = max(1, -(-asked.count() // self.DEALT))
        sent = asked.mapInPandas(route, f"q {kind}, v array<double>, lists array<int>").select("q", "v", F.explode("lists").alias("centroid"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int"))
        held = codes.withColumn("part", F.pmod(F.xxhash64("key"), many).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = sent.groupBy("centroid", "part", "salt").cogroup(held.groupBy("centroid", "part", "salt")).applyInPandas(guess, f"q {kind}, key {mine}, guess double")
        w = Window.partitionBy("q").orderBy("guess", "key")
        few = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= taken).select("q", F.col("key").alias("__k"))
        rows = spark.read.parquet(f"{self.path}/rows").select(F.col(f"`{self.key}`").alias("key"), F.col(vec_col).alias("x"))
        met = few.join(rows, F.col("__k") == F.col("key")).join(asked.select(F.col("q").alias("__q"), "v"), F.col("q") == F.col("__q"))
        w = Window.partitionBy("query_key").orderBy("distance", "key")
        near = met.select(F.col("q").alias("query_key"), "key", DISTANCES["l2"](F.col("x"), F.col("v")).alias("distance"))
        return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, from the differences: right to the last digits for near rows too."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(((a - b) ** 2).sum(1))


def _exists(spark, where: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _encode(left: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(code, scale) of residuals: components from -scale to scale as one of 16 steps, two to a byte."""
    scale = np.abs(left).max(1)
    steps = np.rint((np.divide(left, scale[:, None], out=np.zeros_like(left), where=scale[:, None] > 0) + 1) * 7.5).astype(np.uint8)
    if steps.shape[1] % 2:
        steps = np.hstack((steps, np.zeros((len(steps), 1), np.uint8)))
    return [r.tobytes() for r in steps[:, ::2] << 4 | steps[:, 1::2]], scale


def _decode(code: Sequence[bytes], scale: np.ndarray, width: int) -> np.ndarray:
    """Residuals back from their codes, within half a step."""
    packed = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
    steps = np.stack((packed >> 4, packed & 15), axis=2).reshape(len(code), -1)[:, :width]
    return (steps / 7.5 - 1) * np.asarray(scale, float)[:, None]
