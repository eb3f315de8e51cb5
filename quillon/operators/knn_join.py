"""Nearest neighbours of one table's vectors in another's: pivot cells and triangle bounds.

Both tables are dealt to cells, those of the nearest of a bounded set of pivots. Cells are
packed into blocks of bounded size (a large cell is cut into several), queries into groups of neighbouring cells.
First each query meets the block of its own cell, which bounds the distance of its k-th neighbour. Then it goes to those blocks
only that hold a cell which may have something nearer, by the triangle inequality against
the pivot and by the plane halfway to the query's own pivot. A block is sent once to each group
of queries that asks for it. What comes to the driver is a row per pivot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import pinned

#: Pivots at most, the rows that they are fitted on, and rows of a block and of a group of queries at most.
PIVOTS, SAMPLE, BLOCK, GROUP = 1024, 8192, 16_384, 8192
#: Bytes of the vectors of a block or a group at most.
BYTES = 64 << 20


def _usable(df: DataFrame, vec_col: str, metric: str) -> Column:
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return good & F.exists(v, lambda x: x != 0) if metric == "cosine" else good


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.empty((0, 0))


def _space(x: np.ndarray, metric: str, longest: float, query: bool) -> np.ndarray:
    """Vectors whose Euclidean distances rank as the metric does: unit vectors for the cosine, one more component for the inner product."""
    if metric == "cosine":
        return x / np.sqrt((x * x).sum(1, keepdims=True))
    if metric == "ip":
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0))
        return np.hstack((x, more[:, None]))
    return x


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _measure(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of q to the rows of x, by their differences."""
    if metric == "ip":
        return -(x @ q)
    if metric == "cosine":
        return 1 - (x @ q) / np.sqrt((x * x).sum(1) * (q @ q))
    return np.sqrt(((x - q) ** 2).sum(1))


def _packed(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, number of parts) of each cell: small cells share a part with those next to them in order, large ones are cut."""
    first, parts = np.zeros(len(sizes), int), np.ones(len(sizes), int)
    part, held = 0, 0
    for c in order:
        n = int(sizes[c])
        if n > most or held + n > most:
            part, held = part + (held > 0), 0
        first[c], parts[c] = part, max(1, -(-n // most))
        if n > most:
            part += parts[c]
        else:
            held += n
    return first, parts


class _Cells:
    """What is known of the cells: a row per pivot."""

    def __init__(self, pivots: np.ndarray, metric: str, longest: float):
        self.pivots, self.metric, self.longest = pivots, metric, longest
        self.apart = _apart(pivots, pivots)
        centred = pivots - pivots.mean(0)
        self.order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")

    def nearest(self, x: np.ndarray, query: bool, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        d = _apart(_space(x, self.metric, self.longest, query), self.pivots)
        if among is not None:
            d[:, ~among] = np.inf
        cell = d.argmin(1)
        return cell, d[np.arange(len(d)), cell]

    def reached(self, x: np.ndarray, radius: np.ndarray, home: np.ndarray, sizes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """(queries, cells): whether a cell may hold something within radius."""
        d = _apart(_space(x, self.metric, self.longest, True), self.pivots)
        own = d[np.arange(len(d)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(self.apart[home] > 0, (d * d - own * own) / (2 * self.apart[home]), 0)
        bound = np.maximum(np.maximum(d - most, least - d), plane)
        slack = 1e-6 * (1 + d + most)  # far above what rounding does to distances, far below what separates cells
        return (bound - slack <= radius[:, None]) & (sizes > 0)


def _nearest_in(wanted: np.ndarray, names: np.ndarray, have: np.ndarray, keys: np.ndarray, k: int, metric: str, skip_self: bool):
    """For each query (positions in have, distances) of the k nearest, by distance and then key."""
    scale = (have * have).sum(1)
    for i in range(0, len(wanted), 128):
        q = wanted[i : i + 128]
        dot = q @ have.T
        rough = -dot if metric == "ip" else -dot / np.sqrt(scale)[None, :] if metric == "cosine" else scale[None, :] - 2 * dot
        if skip_self:
            rough[names[i : i + 128, None] == keys[None, :]] = np.inf
        m = min(k, rough.shape[1])
        kth = np.partition(rough, m - 1, axis=1)[:, m - 1]
        size = np.sqrt((q * q).sum(1))
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)) + size * np.sqrt(scale.max(initial=0)) + size * size)
        for j in range(len(q)):
            some = np.flatnonzero(np.isfinite(rough[j]) & (rough[j] <= kth[j] + slack[j]))
            d = _measure(q[j], have[some], metric)
            best = np.lexsort((keys[some], d))[:k]
            yield some[best], d[best]


def _radius(d: np.ndarray, k: int, metric: str, q: np.ndarray, longest: float) -> float:
    """The k-th distance as one of the space; without bound if there are fewer."""
    if len(d) < k:
        return np.inf
    if metric == "l2":
        return float(d[k - 1])
    return float(np.sqrt(max(2 * d[k - 1] if metric == "cosine" else q @ q + longest * longest + 2 * d[k - 1], 0)))


def knn_join(corpus: DataFrame, queries: DataFrame, k: int, key: str, vec_col: str, metric: str = "l2", skip_self: bool = True) -> DataFrame:
    """(query_key, key, distance, rank): the k corpus rows nearest to each query row, ties by key; exact.

    metric: l2, cosine or ip (negated). Vectors that are null, empty or hold null or non-finite elements, and zero
    vectors for the cosine, have no part; all others are of one length. With skip_self, rows of the query's own key are left out.
    """
    spark = corpus.sparkSession
    kind = dict(corpus.dtypes)[key]
    wide = "array<float>" if all(dict(df.dtypes)[vec_col] == "array<float>" for df in (corpus, queries)) else "array<double>"
    out = f"query_key {kind}, key {kind}, distance double, rank int"
    rows, asked = (df.filter(_usable(df, vec_col, metric)).select(F.col(key).alias("key"), F.col(vec_col).cast(wide).alias("v")) for df in (corpus, queries))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], out)

    sample = _space(_matrix(rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()["v"]), metric, longest, False)
    wanted = min(PIVOTS, max(1, int(np.sqrt(n))), len(sample))
    pivots = sample[np.linspace(0, len(sample) - 1, wanted).astype(int)]
    for _ in range(4):
        owner = _apart(sample, pivots).argmin(1)
        pivots = np.stack([sample[owner == i].mean(0) if (owner == i).any() else pivots[i] for i in range(wanted)])
    cells = _Cells(pivots, metric, float(longest))

    def placed(query: bool, among: np.ndarray | None = None):
        def run(batches):
            for batch in batches:
                cell, r = cells.nearest(_matrix(batch["v"]), query, among) if len(batch) else ([], [])
                yield batch.assign(cell=cell, r=r)

        return run

    schema = f"key {kind}, v {wide}, cell int, r double"
    held = pinned(rows.mapInPandas(placed(False), schema))
    sizes, least, most = np.zeros(wanted), np.full(wanted, np.inf), np.zeros(wanted)
    for c, size, low, high in held.groupBy("cell").agg(F.count("*"), F.min("r"), F.max("r")).collect():
        sizes[c], least[c], most[c] = size, low, high
    asking = pinned(asked.mapInPandas(placed(True, sizes > 0), schema))
    per_cell = np.zeros(wanted)
    for c, size in asking.groupBy("cell").count().collect():
        per_cell[c] = size
    fits = max(1, BYTES // (8 * pivots.shape[1]))
    tasks = 2 * spark.sparkContext.defaultParallelism
    first, parts = _packed(sizes, cells.order, min(BLOCK, fits, max(1024, -(-n // tasks))))
    group_first, group_parts = _packed(per_cell, cells.order, min(GROUP, fits, max(256, -(-n_asked // tasks))))

    def dealt(first: np.ndarray, parts: np.ndarray, *salt: str) -> Column:
        at = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
        return at(first) + F.pmod(F.xxhash64(*salt), at(parts)).cast("int")

    held = held.withColumn("block", dealt(first, parts, "key", "v")).select("block", "key", "v")
    asking = asking.withColumn("block", dealt(first, parts, "key", "v")).withColumn("group", dealt(group_first, group_parts, "v", "key"))

    def bound(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        wanted, have, names, keys = _matrix(q["v"]), _matrix(x["v"]), q["key"].to_numpy(), x["key"].to_numpy()
        radius = np.full(len(q), np.inf)
        if len(x):
            radius = np.array([_radius(d, k, metric, wanted[i], cells.longest) for i, (_, d) in enumerate(_nearest_in(wanted, names, have, keys, k, metric, skip_self))])
        if not len(q):
            return pd.DataFrame({"key": [], "v": [], "group": [], "radius": [], "blocks": []})
        seen = cells.reached(wanted, radius, q["cell"].to_numpy(), sizes, least, most)
        blocks = [sorted({b for c in np.flatnonzero(s) for b in range(first[c], first[c] + parts[c])}) for s in seen]
        return q[["key", "v", "group"]].assign(radius=radius, blocks=blocks)

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_key": [], "key": [], "distance": []})
        names, keys = q["key"].to_numpy(), x["key"].to_numpy()
        found = list(_nearest_in(_matrix(q["v"]), names, _matrix(x["v"]), keys, k, metric, skip_self))
        return pd.DataFrame({"query_key": np.repeat(names, [len(p) for p, _ in found]), "key": np.concatenate([keys[p] for p, _ in found]), "distance": np.concatenate([d for _, d in found])})

    def met(asks: DataFrame, run, schema: str) -> DataFrame:
        """run over each group of queries with each block that it asks for."""
        pairs = asks.select("block", "group").distinct().select(F.col("block").alias("to"), F.col("group").alias("by"))
        sent = held.join(pairs, F.col("block") == F.col("to")).select("to", "by", "key", "v")
        return asks.groupBy("block", "group").cogroup(sent.groupBy("to", "by")).applyInPandas(run, schema)

    routed = pinned(met(asking, bound, f"key {kind}, v {wide}, group int, radius double, blocks array<int>"))
    near = met(routed.select("key", "v", "group", F.explode("blocks").alias("block")), best, f"query_key {kind}, key {kind}, distance double")
    w = Window.partitionBy("query_key").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

