"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_grouped, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (node, component) for each node that is not its component's least.

    Each round points every node at its least neighbour, twice, and is written to the
    shared folder; rounds number about the logarithm of the longest path. A hub's
    neighbours are reduced to their minimum by partial aggregation, never gathered, and
    its edges meet that minimum wherever they lie, as hubs are few enough to broadcast.
    """
    now = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join_grouped(both.filter("b > a"), least, "a", "n", 2 * before[0], ["a", "b"])
        large = materialise(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_grouped(large, least, "a", "n", large.count(), ["a", "b"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialise(small.select("e.a", "e.b").filter("a != b").distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
