"""Toxicity by compression distance.

Two Zstandard dictionaries are made, one of ordinary and one of toxic labelled texts. A
text is cut into windows of words; each is compressed with either dictionary, and the
bytes that the toxic one saves are its distance. A document's distances (mean, three
largest, largest) are calibrated to a probability on folds that the dictionaries of that
fold have not seen, and cut at a threshold.

Words are first recoded to symbols of fixed width, hashes of whole words, so that a
match costs Zstandard the same few bytes whether a word is short or long, and
chance matches of letters cannot occur. Dictionaries are raw content, not the work of
Zstandard's own trainer, which fills them with what is frequent rather than with what
tells the classes apart (figures in the README): every symbol that one of COMMON ordinary
texts has, and in the toxic one also those over-represented there.

Fitting sees a bounded sample: at most SAMPLE documents of each label, in hash order of
their ids. Calibration weights a sampled document by the labels it stands for, so that
scores follow the shares of all labels at any size. Scoring sees whole texts of all documents.

Defined results: null and empty texts, and texts without a word, have distances of 0
and the score that follows from these; without labels of both kinds the score is
the share of label 1 among those there are, or 0; labels that are null or have a null id are not used;
repeated rows get the same score; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches

#: Labelled documents of each label that fitting sees at most.
SAMPLE = 2000
#: Words of a window, bytes of a symbol, Zstandard's level.
WINDOW_WORDS, SYMBOL, LEVEL = 16, 12, 6
#: Ordinary symbols: in one of COMMON ordinary texts, and in two, at least; over-represented: in OVER times as large a share of toxic texts, and in one of RARE of them, and in two, at least.
COMMON, OVER, RARE = 400, 10.0, 100
WORDS_KEPT = 300_000
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]  # bias, mean, top three, largest
    constant: float | None = None


class Windows:
    """Distances of a text's windows under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=params)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic).compress

    def features(self, text: str | None) -> tuple[float, float, float]:
        codes = [symbols(w) for w in _WORD.findall((text or "").lower())]
        if not codes:
            return 0.0, 0.0, 0.0
        windows = [b"".join(codes[i : i + WINDOW_WORDS]) for i in range(0, len(codes), WINDOW_WORDS)]
        d = np.sort([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows])[::-1]
        return float(d.mean()), float(d[:3].mean()), float(d[0])


_SYMBOLS: dict[str, bytes] = {}


def symbols(word: str) -> bytes:
    found = _SYMBOLS.get(word)
    if found is None:
        if len(_SYMBOLS) >= WORDS_KEPT:
            _SYMBOLS.clear()
        found = _SYMBOLS[word] = hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=SYMBOL, person=b"word").digest()
    return found


def _document_frequencies(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for text in texts:
        out.update({symbols(w) for w in _WORD.findall(text.lower())})
    return out


def train_dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Raw-content dictionaries; the likeliest symbols stand last, where offsets are smallest."""
    plain, bad = _document_frequencies(ordinary), _document_frequencies(toxic)
    common = sorted((s for s, n in plain.items() if n >= max(2, len(ordinary) / COMMON)), key=lambda s: (-plain[s], s))
    least = max(2, len(toxic) // RARE)
    rate = lambda s: (bad[s] / len(toxic)) / ((plain[s] + 0.5) / (len(ordinary) + 1))
    over = sorted((s for s, n in bad.items() if n >= least and rate(s) >= OVER), key=lambda s: (bad[s], s))
    base = b"".join(reversed(common))
    return base, b"".join(over) + base


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the ridge-penalised likelihood; row i counts n[i] times."""
    a, w = np.hstack((np.ones((len(x), 1)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Equal texts count once, as copies would fill a dictionary. stands_for: labels 0 and 1 there are for each one given."""
    rows = sorted(dict(sorted(zip(texts, labels))).items(), key=lambda r: hashlib.blake2b(r[0].encode("utf-8", "replace")).digest())
    x, y = [t for t, _ in rows], np.array([v for _, v in rows], float)
    n = np.where(y > 0, stands_for[1], stands_for[0])
    if len(rows) < 8 or min(y.sum(), len(y) - y.sum()) < 4:
        return Model(b"", b"", [], constant=float(np.average(y, weights=n)) if len(rows) else 0.0)
    split = lambda keep: ([t for t, v, k in zip(x, y, keep) if k and not v], [t for t, v, k in zip(x, y, keep) if k and v])
    fold, features = np.arange(len(x)) % 2, np.zeros((len(x), 3))
    for k in (0, 1):
        if all(split(fold != k)):
            windows = Windows(*train_dictionaries(*split(fold != k)))
            for i in np.flatnonzero(fold == k):
                features[i] = windows.features(x[i])
    weights = _logistic(features, y, n)
    return Model(*train_dictionaries(*split(fold >= 0)), weights=weights.tolist())


def fit_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """docs and labels: those that may be learned from. Fits on the bounded sample."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).filter("__id IS NOT NULL AND __y IN (0, 1)")
    counts = {int(r["__y"]): r["count"] for r in known.groupBy("__y").count().collect()}
    stands_for = tuple(max(1.0, counts.get(y, 0) / SAMPLE) for y in (0, 1))
    chosen = known.filter("__y = 0").orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE).unionByName(known.filter("__y = 1").orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).join(F.broadcast(chosen), "__id").select("__t", "__y")
    sample = rows.toPandas()
    return fit(sample["__t"].tolist(), sample["__y"].astype(int).tolist(), stands_for)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id and score, and the columns named in carry."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"__{c}") for c in carry])
    schema = ", ".join(["id long", "score double", *[f"`__{c}` {kind}" for c, kind in docs.select(*carry).dtypes]])

    def run(batches):
        windows = None if model.constant is not None else Windows(model.ordinary, model.toxic)
        for batch in batches:
            if windows is None:
                p = np.full(len(batch), model.constant)
            else:
                x = np.array([windows.features(t) for t in batch["text"]]).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))
            out = pd.DataFrame({"id": batch["id"].astype("Int64"), "score": p})
            for c in carry:
                out[f"__{c}"] = batch[f"__{c}"]
            yield out

    out = rows.mapInPandas(run, schema)
    return out.select("id", "score", *[F.col(f"__{c}").alias(c) for c in carry])


#: Labels are learned only from documents outside this remainder of crc32(id as text) modulo 4.
HELD_OUT, THRESHOLD = 2, 0.3


def held_out(col: Column) -> Column:
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_from_labels(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with docs' own columns. All of them, if there are too few labels to fit by."""
    model = fit_from_labels(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col)
    if model.constant is not None:
        return docs
    own = list(docs.columns)
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    i, t = own.index(id_col), own.index(text_col)
    out = score(renamed, model, f"c{i}", f"c{t}", carry=tuple(renamed.columns)).filter(F.col("score") < threshold)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)])
