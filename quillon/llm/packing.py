"""Packing tokenised documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder. The remainders'
lengths form a histogram of at most capacity - 1 counts, whatever the corpus
size. Only that histogram reaches the driver: each window starts with the longest
length left, a bitset subset-sum over the remaining multiset finds the fill
closest to capacity, backtracking gives its counts, and the pattern is used as
often as the counts allow. Every use exhausts some length up to fewer copies than
one pattern needs, so the plan has at most sum(1 + capacity / length) patterns:
about 18,000 for 2,048 at any corpus size, which bounds what is broadcast.

Pieces are numbered within each length by hash splits and prefix sums, so that a
length holding any share of the rows is never gathered in one task, and each
piece looks its window up by its number.

Defined results: null and empty texts give the end id alone; an empty table gives
no pieces; rows repeated with one id are packed each on their own.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, small_batches, split_of, splits

CAPACITY = 2048
END_ID = 1
#: GPT-2's published split pattern, the one that byte-level BPE vocabularies of this kind use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoder(path: str):
    """text -> uint32 ids, as the tokenizers library gives them for the vocabulary file at path.

    Where merge order equals id order, the same vocabulary runs in the faster of the
    two libraries; else, or where that one fails on a text, the file's own library runs.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    spec = json.load(open(path, encoding="utf-8"))
    added = spec.get("added_tokens") or []
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocab["".join(p)] for p in pairs]
    plain = (spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges")
             and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
             and made == sorted(made) and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added))
    if not plain:
        return slow
    ranks = {_bytes_of(token): i for token, i in vocab.items() if token not in {a["content"] for a in added}}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added if a.get("special")})

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except BaseException as e:  # noqa: BLE001  the library panics on some extreme inputs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    return encode


@lru_cache(maxsize=1)
def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _bytes_of(token: str) -> bytes:
    table = _byte_alphabet()
    return bytes(table[c] for c in token)


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (little-endian unsigned 32-bit, as binary)."""
    small_batches(docs.sparkSession)

    def cut(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                out += [(i, s, min(capacity, len(ids) - s), len(ids), ids[s : s + capacity].tobytes()) for s in range(0, len(ids), capacity)]
            made = pd.DataFrame(out, columns=["id", "start", "length", "doc_tokens", "ids"])
            made["id"] = made["id"].astype("Int64")
            yield made

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "id long, start long, length long, doc_tokens long, ids binary")


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces of each length go: (length, first, end, per_window, window, offset).

    Pieces first..end-1 of a length lie per_window to a window, from that window on, at that offset.
    """
    left, used = dict(counts), dict.fromkeys(counts, 0)
    window, plan = 0, []
    lengths = sorted(left, reverse=True)
    while lengths:
        head = lengths[0]
        room = capacity - head
        # parts: (length, copies) in powers of two, whose subsets are all usable counts
        reach, history, full, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
        for length in lengths:
            if length > room:
                continue
            most, copies = min(left[length] - (length == head), room // length), 1
            while most > 0:
                copies = min(copies, most)
                history.append((length, copies, reach))
                reach |= (reach << (length * copies)) & mask
                most -= copies
                copies *= 2
            if reach & full:
                break
        at, take = reach.bit_length() - 1, {head: 1}
        for length, copies, before in reversed(history):
            if not before >> at & 1:
                at -= length * copies
                take[length] = take.get(length, 0) + copies
        times, offset = min(left[n] // c for n, c in take.items()), 0
        for n, c in take.items():
            plan.append((n, used[n], used[n] + c * times, c, window, offset))
            used[n] += c * times
            left[n] -= c * times
            offset += n * c
        window += times
        lengths = [n for n in lengths if left[n]]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "id", start_col: str = "start", length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table: it is read more than once)."""
    spark, own = pieces.sparkSession, pieces.columns
    n = splits(pieces.count())
    rows = pieces.withColumn("__split", split_of(n, F.col(id_col), F.col(start_col)))
    parts = rows.groupBy(length_col, "__split").agg(F.count("*").alias("__n"))
    by_length = Window.partitionBy(length_col).orderBy("__split")
    parts = parts.withColumn("__before", F.sum("__n").over(by_length) - F.col("__n"))
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # capacity rows at most
    plan = slack_plan(counts, capacity)
    schema = "__len long, __first long, __end long, __per long, __window long, __at long"
    plan = F.broadcast(spark.createDataFrame(plan, schema))
    within = Window.partitionBy(length_col, "__split").orderBy(id_col, start_col)
    rows = rows.withColumn("__rn", F.row_number().over(within) - 1).join(parts.drop("__n"), [length_col, "__split"])
    rows = rows.withColumn("__rank", F.col("__rn") + F.col("__before"))
    rows = rows.join(plan, (F.col(length_col) == F.col("__len")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    k = F.col("__rank") - F.col("__first")
    window, slot = F.col("__window") + F.floor(k / F.col("__per")), k % F.col("__per")
    return rows.select(*own, window.cast("long").alias("sequence_id"), (F.col("__at") + slot * F.col(length_col)).cast("long").alias("offset"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = tokenised_pieces(docs, tokenizer or tokenizer_path())
    digest = pieces.select("id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(materialise(digest, "pieces")).withColumnRenamed("id", "doc_id")
