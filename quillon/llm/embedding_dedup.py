"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o, padded with zeros to BITS dimensions or more, is rotated by a seeded
random orthogonal matrix; the signs are its code x and f = <o, x> its correction
factor. Code and factor are computed once and stored with the class. For another unit
vector q, <x, q> / f estimates <o, q> without bias, within
EPS * sqrt((1 - f^2) / f^2) / sqrt(bits - 1) up to a tiny probability.

1. Equal vectors collapse to a class, represented by its least id.
2. Each of several tables deals classes by some bits of their codes; the number of bits
   grows with the logarithm of the number of classes and the number of tables with it,
   so that a linked pair meets in some table but for a probability of MISS, averaged over
   how many bits of their codes agree, as all tables draw on the same ones. Within a
   bucket, packed codes whose Hamming distance may belong to a linked pair tie classes
   into clusters (one row per class, no pairs).
3. Vectors of a cluster meet once, in blocks. Pairs are judged in turn by the Hamming
   distance of their packed codes, by the estimate and its bound, and, if both leave them
   open, by the cosine in double precision. Links are counted and confirmed links reduced
   to a spanning forest; nothing is emitted per pair. A cluster above BLOCK classes is
   compared in blocks of two parts each, so that no task holds more than BLOCK; counting
   the links of one dense group is work of the square of its distinct vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do vectors of unequal length; of rows that share an id, the least
vector counts and all of them get its result; rows with a null id link with nothing and
have a null component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_grouped, materialise
from ._graph import connected_components
from ._pairs import UnionFind, draws_needed, runs, whole_runs

MISS, EPS = 1e-4, 4.5
#: Bits of a code at least; longer codes tie fewer vectors that don't link.
BITS = 512
#: Classes per bucket that the number of bits aims at, in a bucket that is compared code by code, and in a block.
AIM, REGION, BLOCK = 16, 2048, 1024


def code_bits(dim: int) -> int:
    return max(BITS, 64 * math.ceil(dim / 64))


@lru_cache(maxsize=8)
def _rotation(dim: int) -> np.ndarray:
    """The first dim columns of a random orthogonal matrix, seeded by its size."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(bits).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim])


@lru_cache(maxsize=8)
def _table_bits(bits: int, k: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(7 * bits + k)
    return np.stack([rng.permutation(bits)[:k] for _ in range(tables)])


def tables_needed(n: int, threshold: float) -> tuple[int, int]:
    """(bits per table, tables) for n classes; for the shortest codes, as longer ones miss less."""
    k = max(8, math.ceil(math.log2(max(2, n / AIM))))
    return k, draws_needed(code_bits(1), 1 - math.acos(threshold) / math.pi, k, MISS)


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither vanish nor overflow."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["vector"]), "<f8").reshape(len(frame), -1)


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector): vectors as binary doubles, null where they link with nothing."""

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch["v"]:
                try:
                    a = np.asarray(v, "<f8") if v is not None else np.empty(0)
                except TypeError:
                    a = np.empty(0)
                good = a.ndim == 1 and a.size and np.isfinite(a).all() and a.any()
                out.append((a + 0.0).astype("<f8").tobytes() if good else None)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "vector": out})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInPandas(pack, "id long, vector binary")


def _packed(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["code"]), np.uint64).reshape(len(frame), -1)


def _most_apart(bits: int, threshold: float) -> float:
    """Differing bits of two codes that a linked pair has at most, up to a tiny probability."""
    p = math.acos(threshold) / math.pi
    return bits * (p + EPS * math.sqrt(p * (1 - p) / bits))


def coded(classes: DataFrame) -> DataFrame:
    """classes: (id, size, vector). Adds dim, code (packed bits) and factor."""

    def run(batches):
        for batch in batches:
            for width, frame in batch.groupby(batch["vector"].map(len)):
                turned = _unit(_vectors(frame)) @ _rotation(width // 8).T
                signs = turned > 0
                factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
                yield frame.assign(dim=width // 8, code=[c.tobytes() for c in np.packbits(signs, axis=1, bitorder="little")], factor=factor)

    return classes.select("id", "size", "vector").mapInPandas(run, "id long, size long, vector binary, dim long, code binary, factor double")


def _dealt(codes: DataFrame, k: int, tables: int) -> DataFrame:
    """codes: (id, dim, code). (id, code, key) for each class and table."""

    def run(batches):
        for batch in batches:
            for width, frame in batch.groupby(batch["code"].map(len)):
                signs = np.unpackbits(_packed(frame).view(np.uint8), axis=1, bitorder="little")
                keys = signs[:, _table_bits(8 * width, k, tables)].astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
                yield frame.assign(keys=list(keys))

    rows = codes.select("id", "dim", "code").mapInPandas(run, "id long, dim long, code binary, keys array<long>")
    rows = rows.select("id", "dim", "code", F.posexplode("keys").alias("t", "bits"))
    return rows.select("id", "code", F.xxhash64("dim", "t", "bits").alias("key"))


def _cluster_edges(coded: DataFrame, threshold: float) -> DataFrame:
    """Ties ids whose codes may belong to a linked pair; all of a bucket above REGION. Out: (a, b)."""

    def tie(batches):
        for frame in whole_runs(batches, "key", 16_384):
            for width, rows in frame.groupby(frame["code"].map(len), sort=False):
                ids, keys, code = rows["id"].to_numpy(), rows["key"].to_numpy(), _packed(rows)
                most, sets = _most_apart(8 * width, threshold), UnionFind(len(ids))
                root, i, step = sets.up, np.arange(len(ids)), 1
                # all buckets at once: each row against the one a step further on, then two, as long as both are in one bucket
                while len(i := i[i + step < len(ids)]) and len(i := i[keys[i] == keys[i + step]]):
                    x = i[root[i] != root[i + step]]
                    x = x[np.bitwise_count(code[x] ^ code[x + step]).sum(1, dtype=np.int32) <= most]
                    for k in x.tolist():
                        sets.join(k, k + step)
                    root, step = sets.roots() if len(x) else root, step + 1
                far = root != np.arange(len(ids))
                if far.any():
                    yield pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    sizes = coded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    found = materialise(coded.join(sizes, "key"), "buckets")
    tied = found.filter(F.col("size") <= REGION).select("key", "id", "code").repartition("key").sortWithinPartitions("key", "id").mapInPandas(tie, "a long, b long")
    large = found.filter(F.col("size") > REGION)
    first = large.groupBy("key").agg(F.min("id").alias("b"))
    return tied.unionByName(large.join(first, "key").select(F.col("id").alias("a"), "b").filter("a != b"))


def _count_links(groups: DataFrame, threshold: float) -> DataFrame:
    """groups: (group, part, id, size, vector, code, factor), sorted by group. Out: (id, links, root), once per group and id.

    Pairs within a part are compared in the group of that part alone, others in that of both.
    """

    def compare(batches):
        for frame in runs(batches, "group"):
            if len(frame) < 2:
                continue
            ids, size, part, f = (frame[c].to_numpy() for c in ("id", "size", "part", "factor"))
            unit, code = _unit(_vectors(frame)), _packed(frame)
            n, bits = len(frame), 64 * code.shape[1]
            most, root_bits = _most_apart(bits, threshold), math.sqrt(bits)
            bound = EPS * np.sqrt((1 - f * f) / (f * f)) / math.sqrt(bits - 1)
            turned, signs = unit @ _rotation(unit.shape[1]).T, np.unpackbits(code.view(np.uint8), axis=1, bitorder="little").astype(bool)
            two = len(set(part)) > 1
            links, sets = np.zeros(n, np.int64), UnionFind(n)
            for at in range(0, n, 64):
                apart = np.bitwise_count(code[at : at + 64, None] ^ code[None, :]).sum(2, dtype=np.int32)
                i, j = np.nonzero(apart <= most)
                i += at
                keep = (i < j) & ((part[i] != part[j]) if two else True)
                i, j = i[keep], j[keep]
                for b in range(0, len(i), 20_000):
                    x, y = i[b : b + 20_000], j[b : b + 20_000]
                    # <code of x, y> / f: twice what y has where x's bits are set, less all that y has
                    estimate = (2 * np.einsum("ij,ij->i", signs[x], turned[y]) - turned[y].sum(1)) / root_bits / f[x]
                    x, y = x[open_ := estimate + bound[x] >= threshold], y[open_]
                    hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    x, y = x[hit], y[hit]
                    np.add.at(links, x, size[y])
                    np.add.at(links, y, size[x])
                    for u, v in zip(x.tolist(), y.tolist()):
                        sets.join(u, v)
            least = pd.Series(ids).groupby(sets.roots()).transform("min").to_numpy()
            linked = links > 0
            if linked.any():
                yield pd.DataFrame({"id": ids[linked], "links": links[linked], "root": least[linked]})

    return groups.mapInPandas(compare, "id long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept."""
    rows = materialise(_usable(vectors, id_col, vec_col), "vectors")
    named = rows.filter("id IS NOT NULL AND vector IS NOT NULL")
    one = named.groupBy("id").agg(F.min("vector").alias("vector"))
    if named.count() > one.count():  # ids repeat: every row of an id stands for its least vector
        least = one.select(F.col("id").alias("i"), F.col("vector").alias("least"))
        rows = materialise(rows.join(least, F.col("id") == F.col("i"), "left").select("id", F.coalesce("least", "vector").alias("vector")), "vectors")
    classes = one.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = materialise(coded(classes.select(F.col("rep").alias("id"), "size", "vector")), "classes")
    k, tables = tables_needed(classes.count(), threshold)

    clusters = connected_components(_cluster_edges(_dealt(classes, k, tables), threshold))
    clusters = materialise(clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("of"))
    members = join_grouped(clusters, sizes, "component", "of", clusters.count(), ["node"]).withColumnRenamed("node", "id")
    parts = F.when(F.col("of") <= BLOCK, 1).otherwise(F.ceil(F.col("of") / (BLOCK // 2))).cast("int")
    members = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("id", "part", F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")).alias("group"))
    met = classes.join(members, "id").select("group", "part", "id", "size", "vector", "code", "factor").repartition("group").sortWithinPartitions("group", "id")
    found = materialise(_count_links(met, threshold), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    ends = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "id", "left").join(ends, F.col("id") == F.col("node"), "left")
    known = known.select("vector", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = join_grouped(rows, known, "vector", "size", rows.count(), ["id"])
    usable = F.col("vector").isNotNull() & F.col("id").isNotNull()
    component = F.when(usable, F.col("component")).otherwise(F.col("id"))
    out = out.select("id", F.when(usable, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_duplicate_vectors(vectors).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.seen = l.a),
least AS (SELECT vec_id, min(seen) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""
