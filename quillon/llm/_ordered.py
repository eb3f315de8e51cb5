"""Rows of a key in order, in segments of bounded size, and digests over keys that span several of them.

A key is short if it has ROWS rows and BYTES bytes at most: all of it meets in one
task as segment 0. Rows of longer keys are sorted over range partitions, numbered
there and cut into segments of ROWS rows, numbered from 1 in the order of the rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Rows of a segment, and rows and bytes of a key that is one segment.
ROW_BITS = 12
BYTES = 16 << 20


def long_keys(df: DataFrame, key: str, weight: Column, size: Column) -> DataFrame:
    """(key) of those above the limits; weight: rows that a row stands for, size: its bytes. Written once, as several plans read it."""
    total = df.groupBy(key).agg(F.sum(weight).alias("n"), F.sum(size).alias("bytes"))
    return materialise(total.filter((F.col("n") > 1 << ROW_BITS) | (F.col("bytes") > BYTES)).select(key), "long-keys")


def segmented(long_rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds seq, a row's place, and seg, its segment. Written once: range bounds differ from plan to plan."""
    at = F.monotonically_increasing_id()  # rises through sorted partitions
    rows = long_rows.orderBy(key, *order).withColumn("seq", at)
    return materialise(rows.withColumn("seg", F.shiftright("seq", ROW_BITS) + 1), "segmented")


def digests(parts: DataFrame, key: str, order: list[str], payloads: list[str]) -> DataFrame:
    """(key, <payload>_sha256 ...): SHA-256 in lowercase hex of each payload's bytes over all parts of a key, in order.

    A digest is sequential, so one task reads all parts of a key, as a stream; what it reads is
    segments, whose contents other tasks have made.
    """

    def run(batches):
        held, sums = None, []
        for batch in batches:
            out = []
            for name, *values in zip(batch[key], *(batch[p] for p in payloads)):
                if name != held:
                    if held is not None:
                        out.append((held, *(s.hexdigest() for s in sums)))
                    held, sums = name, [hashlib.sha256() for _ in payloads]
                for s, v in zip(sums, values):
                    s.update(v)
            yield pd.DataFrame(out, columns=[key, *payloads])
        if held is not None:
            yield pd.DataFrame([(held, *(s.hexdigest() for s in sums))], columns=[key, *payloads])

    rows = parts.select(key, *order, *payloads).repartition(key).sortWithinPartitions(key, *order)
    out = rows.mapInPandas(run, f"{key} string, {', '.join(f'{p} string' for p in payloads)}")
    return out.select(key, *[F.col(p).alias(f"{p}_sha256") for p in payloads])
