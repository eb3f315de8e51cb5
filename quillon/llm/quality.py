"""Quality by weak labels.

Overlapping heuristics each vote good, bad or nothing on a text. Only the counts of
vote patterns leave the corpus, at most 3 to the number of heuristics. From them
expectation-maximisation estimates the share of good texts and, for each heuristic,
how often it votes either way on good and on bad texts. The posterior probabilities
of a bounded sample of documents then train a linear scorer over hashed word shapes,
which scores every document, those too on which no heuristic votes.

Votes, patterns and features cover whole texts of all documents; only the scorer is
fitted on a sample, of at most SAMPLE documents in hash order of their ids.

Defined results: null and empty texts get no vote, the prior as posterior and the
scorer's bias as score; repeated rows are scored alike; an empty table gives no rows;
where no text is judged bad, or none good, every score is the posterior.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, small_batches

SAMPLE, WIDTH, WORDS_KEPT = 4000, 1024, 300_000
GOOD, BAD, NONE = "1", "0", "-"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on with as by at from this are be or an "
    "der die das und in den von zu mit sich ist im für auf ein eine des dem nicht "
    "le la les de des et un une du en est que qui dans pour par sur au avec "
    "el los las del y que se con una por su para es al lo como".split()
)


def _between(value: float, good: Callable[[float], bool], bad: Callable[[float], bool]) -> str:
    return GOOD if good(value) else BAD if bad(value) else NONE


#: (name, share computed from a text's statistics, good, bad)
HEURISTICS: tuple[tuple[str, Callable[[dict], float | None], Callable, Callable], ...] = (
    ("symbols", lambda s: s["symbols"] / s["chars"], lambda v: v < 0.01, lambda v: v > 0.06),
    ("capitals", lambda s: s["capitals"] / s["letters"] if s["letters"] > 20 else None, lambda v: v < 0.15, lambda v: v > 0.4),
    ("repeats", lambda s: s["repeats"] / s["words"] if s["words"] > 5 else None, lambda v: v < 0.05, lambda v: v > 0.2),
    ("distinct words", lambda s: s["distinct"] / s["words"] if s["words"] > 20 else None, lambda v: v > 0.3, lambda v: v < 0.2),
    ("distinct pairs", lambda s: s["pairs"] / s["words"] if s["words"] > 20 else None, lambda v: v > 0.6, lambda v: v < 0.4),
    ("word length", lambda s: s["chars"] / s["words"] - 1 if s["words"] > 5 else None, lambda v: 3 <= v <= 9, lambda v: v < 2 or v > 12),
    ("letters", lambda s: s["letters"] / s["chars"], lambda v: v > 0.72, lambda v: v < 0.55),
    ("shouts", lambda s: s["shouts"] / s["words"] if s["words"] > 5 else None, lambda v: v < 0.02, lambda v: v > 0.2),
    ("function words", lambda s: s["function"] / s["words"] if s["words"] > 20 else None, lambda v: v > 0.08, lambda v: v < 0.01),
    ("separators", lambda s: s["separators"] / s["words"] if s["words"] > 5 else None, lambda v: v < 0.02, lambda v: v > 0.15),
    ("lines", lambda s: 1 - s["distinct lines"] / s["lines"] if s["lines"] > 5 else None, lambda v: v < 0.1, lambda v: v > 0.5),
)
_NOT_PLAIN = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_CAPITAL, _LETTER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]")
_SHAPES: dict[str, int] = {}


def _shape(word: str) -> int:
    """Bucket of a word's shape: runs of capitals, letters, digits, and symbols as they are, and the length's order of magnitude."""
    found = _SHAPES.get(word)
    if found is None:
        if len(_SHAPES) >= WORDS_KEPT:
            _SHAPES.clear()
        shape = "".join(k for k, _ in itertools.groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        found = _SHAPES[word] = zlib.crc32(f"{shape}/{len(word).bit_length()}".encode("utf-8", "replace")) % (WIDTH - 2) + 2
    return found


def look(text: str | None) -> tuple[str, np.ndarray, np.ndarray]:
    """(votes, buckets, values) of a whole text."""
    words = (text or "").split()
    if not words:
        return NONE * len(HEURISTICS), np.zeros(0, np.int32), np.zeros(0, np.float32)
    lines = [line for line in text.splitlines() if line.strip()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    stats = {
        "chars": len(text),
        "words": len(words),
        "symbols": len(_NOT_PLAIN.findall(text)),
        "capitals": len(_CAPITAL.findall(text)),
        "letters": len(_LETTER.findall(text)),
        "repeats": repeats,
        "distinct": len(set(words)),
        "pairs": len(set(zip(words, words[1:]))),
        "shouts": text.count("!!"),
        "function": sum(w in FUNCTION_WORDS for w in text.lower().split()),
        "separators": sum(map(text.count, ("|", "•", "\t", "·"))),
        "lines": len(lines),
        "distinct lines": len(set(lines)),
    }
    votes = "".join(NONE if (v := share(stats)) is None else _between(v, good, bad) for _, share, good, bad in HEURISTICS)
    counts = np.bincount(np.fromiter(map(_shape, words), np.int64, len(words)), minlength=WIDTH) / len(words)
    counts[1] = repeats / len(words)
    at = np.flatnonzero(counts)
    return votes, at.astype(np.int32), np.sqrt(counts[at]).astype(np.float32)


def estimate_accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good texts, table[heuristic, truth, vote]) from counts of vote patterns, by expectation-maximisation.

    Starts from majority votes; votes are smoothed by one of each kind.
    """
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    votes = np.array([[(BAD, GOOD, NONE).index(c) for c in p] for p in names]).reshape(len(names), -1)
    good = np.array([(p.count(GOOD) + 0.5) / (p.count(GOOD) + 2 * p.count(BAD) + 1) for p in names])
    share, table = 0.5, np.full((votes.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        new = float((n * good).sum() + 1) / (n.sum() + 2)
        for truth, weight in ((0, n * (1 - good)), (1, n * good)):
            for v in range(3):
                table[:, truth, v] = (weight[:, None] * (votes == v)).sum(0) + 1
        table /= table.sum(2, keepdims=True)
        good = posterior(votes, new, table)
        if abs(new - share) < 1e-9:
            break
        share = new
    return new, table


def posterior(votes: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of good for rows of votes; a heuristic that does not vote says nothing."""
    logit = np.full(len(votes), math.log(share / (1 - share)))
    for k in range(votes.shape[1]):
        ratio = np.log(table[k, 1, :2] / table[k, 0, :2])
        logit += np.append(ratio, 0.0)[votes[:, k]]
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _dense(rows: pd.DataFrame) -> np.ndarray:
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, values) in enumerate(zip(rows["buckets"], rows["values"])):
        x[i, np.asarray(at, np.int64)] = values
    x[:, 0] = 1
    return x


def train_scorer(x: np.ndarray, good: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps; the bias is bucket 0."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (good - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, votes, posterior, score."""
    small_batches(docs.sparkSession)

    def judge(batches):
        for batch in batches:
            seen = [look(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "votes": [s[0] for s in seen], "buckets": [s[1] for s in seen], "values": [s[2] for s in seen]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(rows.mapInPandas(judge, "id long, votes string, buckets array<int>, values array<float>"), "votes")
    patterns = {r[0]: r[1] for r in rows.groupBy("votes").count().collect()}
    if not patterns:
        return rows.select("id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"))
    share, table = estimate_accuracies(patterns)
    number = lambda texts: np.array([[(BAD, GOOD, NONE).index(c) for c in t] for t in texts]).reshape(len(texts), -1)
    chosen = rows.select("id", "votes", "buckets", "values").orderBy(F.xxhash64("id"), "id", "votes").limit(SAMPLE).toPandas()
    labels = posterior(number(chosen["votes"].tolist()), share, table)
    weights = train_scorer(_dense(chosen), labels) if min(labels.sum(), (1 - labels).sum()) >= 1 else None

    def score(batches):
        for batch in batches:
            p = posterior(number(batch["votes"].tolist()), share, table)
            s = p if weights is None else [1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[0] + weights[np.asarray(a, np.int64)] @ np.asarray(v, float)))))) for a, v in zip(batch["buckets"], batch["values"])]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "votes": batch["votes"], "posterior": p, "score": s})

    return rows.mapInPandas(score, "id long, votes string, posterior double, score double")


#: Documents of at least this score are kept: in doubt, a document stays.
THRESHOLD = 0.3


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.col("score") >= THRESHOLD
    return out.select(F.col("id").alias("doc_id"), "votes", "posterior", "score", kept.cast("int").alias("predicted"), kept.alias("kept"))
