"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row
per digest, sort-merge anti-joined with the index, and what is new is appended.

Defined results: null text counts as empty, and empty texts are equal to each
other; a null id loses to any other id; rows repeated with the same id and text
share one decision (``drop_duplicates`` then keeps one of them); an empty batch
adds nothing; other columns of the input are never read by the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BucketedTable, join_grouped, materialise, scratch_path

SCHEMA = "digest binary, keep_id bigint, group_size bigint, keep_rows bigint"
#: Digests that a bucket of a new index is meant to hold.
BUCKET_ROWS = 1_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row: SHA-256 of the unchanged text in UTF-8."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


class DigestIndex(BucketedTable):
    """Digests seen so far, at a path, bucketed and sorted by digest; later sessions open it by that path.

    An index that exists keeps its buckets; a new one gets buckets for ``expected`` digests.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 0):
        super().__init__(spark, path, SCHEMA, "digest", max(8, -(-expected // BUCKET_ROWS)))

    @staticmethod
    def temporary(batch: DataFrame) -> DigestIndex:
        return DigestIndex(batch.sparkSession, scratch_path(batch.sparkSession, "digest-index"), batch.count())

    def ingest(self, batch: DataFrame) -> DataFrame:
        """batch: (id, digest). Appends the digests that the index lacks, with the largest id and the row count of each; returns what was new."""
        per_id = batch.groupBy("digest", "id").agg(F.count("*").alias("n"))
        fresh = per_id.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.coalesce("id", F.lit(-(2**63)))).alias("keep_rows"))
        fresh = materialise(fresh.join(self.table().select("digest").hint("merge"), "digest", "left_anti"), "fresh")
        # dealt as the table is, so each task writes one sorted file of one bucket
        self.append(fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest"))
        return fresh

    def decide(self, batch: DataFrame) -> DataFrame:
        """batch with keep_id, group_size and keep_rows of its digest."""
        total = self.table().agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        return join_grouped(batch, self.table(), "digest", "group_size", total, ["id"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, keep_rows (rows having both that id and that text).

    With an index, texts seen before keep the id and size that they were first indexed with;
    without, a temporary index is built and dropped.
    """
    batch = materialise(digests(docs, id_col, text_col), "digests")
    used = index or DigestIndex.temporary(batch)
    used.ingest(batch)
    out = used.decide(batch)
    if index is None:
        out = materialise(out, "groups")
        used.drop()
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with docs' own columns. With an index: those of texts that it lacked, which it now has."""
    batch = materialise(digests(docs, id_col, text_col), "digests")
    used = index or DigestIndex.temporary(batch)
    stay = used.ingest(batch).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("keep_rows").alias("__rows"))
    if index is None:
        used.drop()
    keyed = docs.withColumn("__d", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    # the (digest, id) pair is the key here: a hot digest's rows scatter by their ids
    pair = lambda d, i: F.unhex(F.sha2(F.concat(d, F.coalesce(i.cast("string"), F.lit("-")).cast("binary")), 256))
    keyed = keyed.withColumn("__pair", pair(F.col("__d"), F.col(id_col).cast("long"))).drop("__d")
    stay = stay.select(pair(F.col("__digest"), F.col("__keep")).alias("__pair"), "__rows")
    kept = keyed.join(stay, "__pair")
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter("__rows = 1").select(*own)
    more = kept.filter("__rows > 1").dropDuplicates(["__pair"]).select(*own)
    return once.unionByName(more)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_groups(docs)
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
