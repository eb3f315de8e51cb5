"""Near-duplicate documents by a MinHash LSH forest, links confirmed on full shingle sets.

1. Equal shingle sets collapse to a class, represented by its least id. A class is
   labelled by 128 minima, hashed to 16 bits each.
2. An *order* is a fixed permutation of the labels. Each order is one tree of the
   forest: classes sorted by their labels in that order, a node being a run with a
   common prefix. Depth adapts to the region: descent begins at SHALLOW labels, and
   a node of more than LEAF classes is read at the next of DEPTHS. Classes
   that descend are read in more orders. The numbers of orders follow from the
   threshold, averaged over how many of the labels agree, as all orders draw on the
   same ones: a linked pair shares no node of a depth with a probability of at most
   MISS, at SHALLOW or at the deepest.
3. Along a sorted order, classes are tied to the neighbours with the longest common
   prefix, and within a leaf to all whose labels agree well enough (4 standard
   deviations below the threshold at least). What is tied forms clusters, supersets of
   the true components: one row per class and leaf, no pairs. A node still above LEAF
   at the deepest is tied as a whole.
4. Links are confirmed on full sets, and pairs already connected are not compared. A
   cluster's texts meet once, in one task. A cluster above BLOCK_ROWS classes or
   BLOCK_SHINGLES shingles is confirmed in two steps: first in the leaves of LARGE_ORDERS
   orders, which connects most of it in linear work; then the classes outside its largest
   connected part are compared by their labels with all of the cluster, in blocks, and
   texts move again only for those which some label comparison leaves open.
5. Connected components of the confirmed links give each document its component.

Defined results: null and empty texts and texts of white space have empty sets and
link with nothing; rows that share an id are one document, of whose texts the one
with the least digest counts; rows with a null id link with nothing and have a null
component; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_grouped, materialise, small_batches
from ._graph import connected_components
from ._pairs import draws_needed, merge_labels, runs, whole_runs
from ._shingles import U, mix, shingle_set

MINIMA = 128
#: Labels of a prefix at which a node is read; the first is SHALLOW.
DEPTHS = (4, 6, 8)
SHALLOW, DEEP = DEPTHS[0], DEPTHS[-1]
MISS = 1e-4
#: Classes in a leaf; classes and shingles whose texts one task holds, roughly.
LEAF, BLOCK_ROWS, BLOCK_SHINGLES = 512, 1024, 2_000_000
LARGE_ORDERS = 4


def orders_needed(percent: int, depth: int) -> int:
    return draws_needed(MINIMA, percent / 100, depth, MISS)


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def _labels(values: np.ndarray) -> np.ndarray:
    """128 minima of a set of 64-bit hashes, hashed to 16 bits."""
    a = (_constants(MINIMA, 11) >> U(32)).astype(np.uint32) | np.uint32(1)
    b = (_constants(MINIMA, 23) >> U(32)).astype(np.uint32)
    low = (values >> U(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        x = (low[at : at + 4096, None] ^ b) * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(0), out=out)
    return (mix(out.astype(U)) & U(0xFFFF)).astype("<u2")


@lru_cache(maxsize=8)
def _orders(count: int) -> np.ndarray:
    """Which labels stand first in each of count orders; fewer orders are a prefix of more."""
    ranks = mix(_constants(count, 37)[:, None] ^ _constants(MINIMA, 41)[None, :])
    return np.argsort(ranks, axis=1)[:, :DEEP]


def _paths(labels: np.ndarray, count: int) -> np.ndarray:
    """labels: (classes, 128). (classes, count, 2): the first four labels in each order as one sortable integer, and the next four."""
    chosen = np.ascontiguousarray(labels[:, _orders(count)].astype(">u2"))
    return chosen.view(">i8").astype(np.int64)


def _least_agreeing(percent: int) -> float:
    p = percent / 100
    return MINIMA * (p - 4 * math.sqrt(p * (1 - p) / MINIMA))


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, digest, labels) of every row; the last two are null for an empty set."""
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                s = shingle_set(text, words)
                out.append((i, len(s), _digest(s), _labels(s).tobytes()) if len(s) else (i, 0, None, None))
            made = pd.DataFrame(out, columns=["id", "n", "digest", "labels"])
            made["id"] = made["id"].astype("Int64")
            yield made

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(sign, "id long, n long, digest binary, labels binary")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sorted_orders(classes: DataFrame, count: int) -> DataFrame:
    """classes: (id, n, labels). (o, hi, lo, id, n): each class's place in each order."""

    def place(batches):
        for batch in batches:
            if len(batch):
                p = _paths(_matrix(batch["labels"], "<u2"), count)
                yield pd.DataFrame({"id": batch["id"], "n": batch["n"], "hi": list(p[:, :, 0]), "lo": list(p[:, :, 1])})

    rows = classes.select("id", "n", "labels").mapInPandas(place, "id long, n long, hi array<long>, lo array<long>")
    rows = rows.select("id", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("o", "p"))
    return rows.select("o", F.col("p.hi").alias("hi"), F.col("p.lo").alias("lo"), "id", "n")


def _cut(depth: int):
    """The labels after the fourth that a node of this depth has in common."""
    return F.col("lo").bitwiseAND(F.lit(-1 << 16 * (DEEP - depth))) if depth > 4 else F.lit(0).cast("long")


def _descend(rows: DataFrame, depths: tuple[int, ...], most_rows: int, most_shingles: int | None, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Leaves (o, hi, cut, lo, id, n, size, shingles) of more than one class, and the rows of nodes that are too large even at the deepest."""
    leaves, node = None, [*within, "o", "hi", "cut"]
    for depth in depths:
        keyed = rows.drop("cut", "size", "shingles").withColumn("cut", _cut(depth))
        sizes = keyed.groupBy(*node).agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
        met = materialise(keyed.join(sizes, node), "nodes")
        fits = F.col("size") <= most_rows
        if most_shingles:
            fits = fits & (F.col("shingles") <= most_shingles)
        found, rows = met.filter(fits), met.filter(~fits)
        leaves = found if leaves is None else leaves.unionByName(found)
    return leaves, rows


def forest(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Leaves of the whole forest, and the rows (o, hi, cut, id) of nodes to be tied as a whole."""
    leaves, dense = _descend(_sorted_orders(classes, orders_needed(percent, SHALLOW)), DEPTHS[:1], LEAF, None)
    dense = dense.select("id").distinct()
    if dense.isEmpty():
        return leaves, leaves.limit(0)
    deeper = materialise(_sorted_orders(classes.join(dense, "id", "left_semi"), orders_needed(percent, DEEP)), "orders")
    more, rest = _descend(deeper, DEPTHS, LEAF, None)
    return leaves.unionByName(more), rest


def _tie_neighbours(leaves: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Walks each sorted order. Ties (a, b) of neighbours, and of all in a leaf whose labels agree."""
    least = _least_agreeing(percent)

    def walk(batches):
        for frame in whole_runs(batches, "node"):
            node, ids, n = (frame[c].to_numpy() for c in ("node", "id", "n"))
            marks = _matrix(frame["labels"], "<u2").astype(np.uint8)  # a byte of each label suffices here
            near = (node[1:] == node[:-1]) & ((marks[1:] == marks[:-1]).sum(1) >= least) & (100 * np.minimum(n[1:], n[:-1]) >= percent * np.maximum(n[1:], n[:-1]))
            # classes tied along the order carry one label; a leaf with several needs a closer look
            part = np.concatenate(([0], np.cumsum(~near)))
            a, b = [ids[1:][near]], [ids[:-1][near]]
            edges = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s < 3 or part[s] == part[e - 1]:
                    continue
                own = part[s:e].copy()
                for i in range(1, e - s):
                    js = np.flatnonzero(own[:i] != own[i])
                    if len(js):
                        js = js[100 * np.minimum(n[s + js], n[s + i]) >= percent * np.maximum(n[s + js], n[s + i])]
                        js = js[(marks[s + js] == marks[s + i]).sum(1) >= least]
                        _, first = np.unique(own[js], return_index=True)
                        a.append(np.full(len(first), ids[s + i]))
                        b.append(ids[s + js[first]])
                        merge_labels(own, i, js)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})

    rows = leaves.select("o", "hi", "cut", "lo", "id").join(classes.select("id", "n", "labels"), "id")
    rows = rows.repartitionByRange("o", "hi", "cut").sortWithinPartitions("o", "hi", "cut", "lo", "id")
    return rows.select(F.xxhash64("o", "hi", "cut").alias("node"), "id", "n", "labels").mapInPandas(walk, "a long, b long")


class _Sets:
    """Sets of a few texts, for repeated intersections."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(self.flat.max() + 1, bool)

    def linked(self, i: int, js: np.ndarray, percent: int) -> np.ndarray:
        """Those of js that link with i."""
        js = js[100 * np.minimum(self.sizes[js], self.sizes[i]) >= percent * np.maximum(self.sizes[js], self.sizes[i])]
        if not len(js):
            return js
        mine, sizes = self.flat[self.starts[i] : self.starts[i + 1]], self.sizes[js]
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.repeat(self.starts[js] - begin, sizes) + np.arange(sizes.sum())
        self.mark[mine] = True
        both = np.add.reduceat(self.mark[self.flat[at]], begin, dtype=np.int64)
        self.mark[mine] = False
        return js[100 * both >= percent * (self.sizes[i] + sizes - both)]


def _read_sets(frame: pd.DataFrame, words: int) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """A frame without repeated rows and without texts that aren't the ones their id stands for, and the sets."""
    frame = frame.drop_duplicates(["id", "text"])
    sets = [shingle_set(t, words) for t in frame["text"]]
    if frame["id"].duplicated().any():
        right = [len(s) > 0 and _digest(s) == d for s, d in zip(sets, frame["digest"])]
        sets = [s for s, r in zip(sets, right) if r]
        frame = frame[right]
        once = ~frame["id"].duplicated().to_numpy()
        frame, sets = frame[once], [s for s, o in zip(sets, once) if o]
    return frame, sets


def _confirm(met: DataFrame, words: int, percent: int) -> DataFrame:
    """met: (group, id, digest, text), sorted by group within partitions. A spanning forest (a, b) of each group's links."""

    def compare(batches):
        for frame in runs(batches, "group"):
            frame, sets = _read_sets(frame, words)
            if len(sets) < 2:
                continue
            ids, sets, own = frame["id"].to_numpy(), _Sets(sets), np.arange(len(sets))
            a, b = [], []
            for i in np.argsort(-sets.sizes, kind="stable"):
                js = sets.linked(i, np.flatnonzero(own != own[i]), percent)
                _, first = np.unique(own[js], return_index=True)
                a += [ids[i]] * len(first)
                b += ids[js[first]].tolist()
                merge_labels(own, i, js)
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return met.mapInPandas(compare, "a long, b long")


def _with_texts(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """A plan that holds at any size: each text moves once for each group it is in, and no list of ids is broadcast."""
    return texts.join(groups.hint("merge"), "id").repartition("group").sortWithinPartitions("group", "id")


def _confirm_large(large: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """large: (id, digest, cluster, of, total). Links (a, b) of clusters that are too large for one task."""
    rows = _sorted_orders(classes.join(large.select("id"), "id", "left_semi"), LARGE_ORDERS).join(large.select("id", "cluster"), "id")
    leaves, rest = _descend(materialise(rows, "large"), DEPTHS, BLOCK_ROWS, BLOCK_SHINGLES, ("cluster",))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES) * 2)
    rest = rest.withColumn("split", F.pmod(F.xxhash64("id", "o"), parts))
    node = ["cluster", "o", "hi", "cut"]
    groups = leaves.select("id", F.xxhash64(F.lit("leaf"), *node).alias("group")).unionByName(rest.select("id", F.xxhash64(F.lit("split"), "split", *node).alias("group")))
    groups = groups.join(large.select("id", "digest"), "id")
    first = materialise(_confirm(_with_texts(groups, texts), words, percent), "links")

    # what is outside the largest connected part of its cluster meets all of the cluster, by labels
    ends = connected_components(first).select(F.col("node").alias("id"), F.col("component").alias("part"))
    members = large.join(ends, "id", "left").withColumn("part", F.coalesce("part", "id")).join(classes.select("id", "n", "labels"), "id")
    members = materialise(members, "members")
    sizes = members.groupBy("cluster", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    of_outer = members.join(main, "cluster").filter("part <> main").groupBy("cluster").agg(F.first("main").alias("main"), F.count("*").alias("n_outer"), F.sum("n").alias("s_outer"))
    met = join_grouped(members, of_outer.join(members.groupBy("cluster").agg(F.count("*").alias("n_all")), "cluster"), "cluster", "n_all", members.count(), ["id"]).filter("main IS NOT NULL")
    count = lambda rows, shingles: F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) / BLOCK_SHINGLES)).cast("int")
    met = met.withColumn("p_outer", count("n_outer", "s_outer")).withColumn("p_all", count("of", "total"))
    own = lambda p: F.pmod(F.xxhash64("id"), F.col(p)).cast("int")
    every = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    keep = ["cluster", "id", "part", "n", "digest", "labels"]
    outer = met.filter("part <> main").select(*keep, F.lit(True).alias("outer"), own("p_outer").alias("i"), every("p_all").alias("j"))
    inner = met.select(*keep, F.lit(False).alias("outer"), own("p_all").alias("j"), every("p_outer").alias("i"))
    blocks = outer.unionByName(inner).select(F.xxhash64("cluster", "i", "j").alias("group"), *keep[1:], "outer")
    blocks = blocks.repartition("group").sortWithinPartitions("group", "id")
    least = _least_agreeing(percent)

    def open_pairs(frame: pd.DataFrame):
        """For each outer row, the rows that its labels leave open."""
        outer, n, part = frame["outer"].to_numpy(), frame["n"].to_numpy(), frame["part"].to_numpy()
        marks = _matrix(frame["labels"], "<u2").astype(np.uint8)
        for i in np.flatnonzero(outer):
            js = np.flatnonzero((part != part[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            js = js[(marks[js] == marks[i]).sum(1) >= least]
            if len(js):
                yield i, js

    def filter_open(batches):
        for frame in runs(batches, "group"):
            frame = frame.sort_values("outer", ascending=False, kind="stable").drop_duplicates("id")  # an outer class may be met as one of all, too
            keep = np.zeros(len(frame), bool)
            for i, js in open_pairs(frame):
                keep[i] = keep[js] = True
            if keep.any():
                yield frame[keep]

    schema = "group long, id long, part long, n long, digest binary, labels binary, outer boolean"
    left = materialise(blocks.mapInPandas(filter_open, schema), "open")

    def compare(batches):
        for frame in runs(batches, "group"):
            frame, sets = _read_sets(frame, words)
            if len(sets) < 2:
                continue
            ids, sets, (_, own) = frame["id"].to_numpy(), _Sets(sets), np.unique(frame["part"], return_inverse=True)
            a, b = [], []
            for i, js in open_pairs(frame):
                js = sets.linked(i, js[own[js] != own[i]], percent)
                a += [ids[i]] * len(js)
                b += ids[js].tolist()
                merge_labels(own, i, js)
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    second = _with_texts(left, texts).mapInPandas(compare, "a long, b long")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept. Links at a Jaccard similarity of percent / 100."""
    rows = materialise(signatures(docs, id_col, text_col, words), "signatures")
    named = rows.filter("id IS NOT NULL AND digest IS NOT NULL")
    counts = rows.filter("id IS NOT NULL").agg(F.count("id"), F.countDistinct("id")).first()
    if counts[0] > counts[1]:  # ids repeat: every row of an id stands for its least digest
        one = named.groupBy("id").agg(F.min_by(F.struct("digest", "n", "labels"), "digest").alias("s")).select(F.col("id").alias("i"), "s.*")
        named = materialise(one.withColumnRenamed("i", "id"), "named")
        own = named.select(F.col("id").alias("i"), F.col("digest").alias("d"), F.col("n").alias("m"))
        rows = materialise(rows.join(own, F.col("id") == F.col("i"), "left").select("id", F.coalesce("m", "n").alias("n"), F.coalesce("d", "digest").alias("digest")), "rows")
    classes = named.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    classes = materialise(classes, "classes")

    leaves, whole = forest(classes, percent)
    node = ["o", "hi", "cut"]
    first = whole.groupBy(*node).agg(F.min("id").alias("b"))
    edges = _tie_neighbours(leaves, classes, percent).unionByName(whole.join(first, node).select(F.col("id").alias("a"), "b"))
    clusters = connected_components(edges)
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    clusters = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(classes.select("id", "n", "digest"), "id")
    clusters = materialise(clusters, "clusters")

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("of"), F.sum("n").alias("total"))
    members = join_grouped(clusters.drop("n"), sizes, "cluster", "of", clusters.count(), ["id"])
    members = materialise(members, "clustered")
    is_large = (F.col("of") > BLOCK_ROWS) | ((F.col("total") > BLOCK_SHINGLES) & (F.col("of") > 2))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    groups = members.filter(~is_large).select("id", "digest", F.col("cluster").alias("group"))
    links = _confirm(_with_texts(groups, texts), words, percent)
    large = members.filter(is_large)
    if not large.isEmpty():
        links = links.unionByName(_confirm_large(large, classes, texts, words, percent))
    ends = connected_components(links)

    known = classes.select("digest", "id", "size").join(ends, F.col("id") == F.col("node"), "left")
    known = known.select("digest", "size", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.col("digest")).alias("digest"))
    out = join_grouped(out, known, "digest", "size", rows.count(), ["id"])
    out = out.withColumn("component_id", F.coalesce("component", "id"))
    return out.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document stays, with docs' own columns."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).filter("NOT kept").select(F.col("id").alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\x0c\r]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS met FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * met >= 85 * (na + nb - met)),
reached AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.seen = l.a),
least AS (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least JOIN sets USING (doc_id)
"""
