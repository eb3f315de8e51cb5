"""A corpus pipeline: each stage works on all that its predecessor kept.

toxicity, exact dedup, MinHash near-dedup, mixing sources to target weights, packing.
All stages but the last return the columns of documents; the last returns the packed
pieces with their token ids.

Defined results: null and empty texts pass the classifier and are equal to each other; the one that stays is
near to nothing; the mix takes texts by their words, so one without any is not taken. Documents without an
id go the same way, as one document where their texts are equal. Repeated rows of an id and text become one. An empty table gives
empty stages. Other columns are carried along, whatever their names. Ties fall as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from quillon.llm._common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels outside the held-out remainder, doesn't reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five words and a similarity of 0.8, the document with the least id."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the curriculum takes them, in training order."""
    return mixing.sample_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset."""
    pieces = materialise(packing.tokenised_pieces(docs, packing.tokenizer_path()), "pieces")
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can express neither the classifier nor the packing; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
