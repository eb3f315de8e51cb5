"""Product-quantisation codes by exact integer k-means, assigned by exponion search.

A component x becomes the integer floor(1024 x); vectors are cut into PARTS equal parts,
each with a codebook of up to ENTRIES entries. To assign a part, search starts at its
previous entry a, at squared distance u. An entry nearer than a, or as near, is within
2 sqrt(u) of a, by the triangle inequality: so of the entries sorted by their distance
from a, those with a squared distance of 4 u at most are enough, and all of them are
compared. Distances are exact: in double precision while their terms stay below 2^53, in 64-bit
integers beyond; the least index wins a tie.
The codebooks (PARTS * ENTRIES rows at most) travel with the tasks; each round stores the codes, the next one's
start, and sums each entry's parts before the shuffle.

Defined results: vectors that are null, empty or hold null or non-finite components go; so do those whose
length isn't that of the vector with the least id, or is no multiple of PARTS; components of 65,536 and more in
magnitude raise an error, as errors of long vectors would leave the range of a long; of rows with equal ids, the initial entries take the
least vectors first, and every row is coded; null ids come last; with fewer than ENTRIES rows there are
as many entries; labels that are null count together; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_grouped, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest magnitude of an integer component: errors of vectors up to 512 long stay below 2^63.
LARGEST = 1 << 26


class Neighbours:
    """The entries of one codebook, each with all of them sorted by squared distance from it, ties by index."""

    def __init__(self, book: np.ndarray, kind: type | None = None):
        self.book = book.astype(kind or self.kind(book))
        self.norms = (self.book**2).sum(1)
        apart = self.norms[:, None] + self.norms[None, :] - 2 * self.book @ self.book.T
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    @staticmethod
    def kind(x: np.ndarray) -> type:
        """Doubles, which multiply fastest, where they are exact."""
        return float if 4 * x.shape[1] * float(np.abs(x).max(initial=0)) ** 2 < 1 << 53 else np.int64

    def search(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) nearest to each row of x."""
        if self.kind(x) is np.int64 and self.book.dtype == float:
            return Neighbours(self.book.astype(np.int64), np.int64).search(x, previous)
        x = x.astype(self.book.dtype)
        entry, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        by = np.argsort(previous, kind="stable")
        cuts = np.flatnonzero(np.diff(previous[by])) + 1
        for rows in np.split(by, cuts):
            if not len(rows):
                continue
            a = previous[rows[0]]
            part = x[rows]
            norms = (part**2).sum(1)
            near = norms + self.norms[a] - 2 * part @ self.book[a]
            reach = np.searchsorted(self.apart[a], 4 * near, side="right")
            deal = np.argsort(reach, kind="stable")
            # rows that reach about as far are compared at once, so few look beyond their own radius
            for at in range(0, len(deal), 256):
                some = deal[at : at + 256]
                held = np.sort(self.order[a, : reach[some[-1]]])
                d = norms[some, None] + self.norms[held] - 2 * part[some] @ self.book[held].T
                first = d.argmin(1)
                entry[rows[some]], least[rows[some]] = held[first], d[np.arange(len(some)), first]
        return entry, least


def _parts(frame: pd.DataFrame) -> np.ndarray:
    """(rows, PARTS, width) of the integers in binary column v."""
    return np.frombuffer(b"".join(frame["v"]), "<i4").reshape(len(frame), PARTS, -1).astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vec_col: str, keep: list[str]) -> DataFrame:
    """id, keep columns and v, the floored components as packed 32-bit integers; only rows that are kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(vec_col).alias("v"))
    # nulls and NaN fail the comparison; infinities exceed every double
    finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x.cast("double")) <= 1.7976931348623157e308) & ~F.isnan(x), F.lit(False)))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    first = rows.select(F.coalesce(F.min_by(F.size("v"), F.struct(F.col("id").isNull(), "id", "v")), F.lit(0))).first()[0]
    rows = rows.filter((F.size("v") == first) & (first % PARTS == 0))

    def pack(batches):
        for batch in batches:
            x = np.floor(SCALE * np.array([np.asarray(v, float) for v in batch["v"]]).reshape(len(batch), -1))
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST / SCALE:g}, beyond which distances aren't exact")
            yield batch.assign(v=[r.tobytes() for r in x.astype("<i4")])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(pack, "id long, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "v binary")


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with code (one byte a part) and error from books; code holds the entries that the search starts from, null for entry 0."""
    start = np.zeros(PARTS, np.uint8).tobytes()

    def run(batches):
        known = [Neighbours(b) for b in books]
        for batch in batches:
            if not len(batch):
                continue
            x = _parts(batch)
            before = np.frombuffer(b"".join(c if c is not None else start for c in batch["code"]), np.uint8).reshape(-1, PARTS).astype(np.int64)
            found = [known[p].search(x[:, p], before[:, p]) for p in range(PARTS)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield batch.assign(code=[c.tobytes() for c in codes], error=np.sum([f[1] for f in found], 0))

    return rows.mapInPandas(run, rows.select("*").drop("error").schema.add("error", "long"))


def means(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """The floored means of each entry's parts; an entry without parts stays. What reaches the driver is a row per entry."""
    width = books.shape[2]

    def fold(batches):
        total, n = np.zeros((PARTS, books.shape[1], width), np.int64), np.zeros((PARTS, books.shape[1]), np.int64)
        for batch in batches:
            if len(batch):
                x = _parts(batch)
                codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(-1, PARTS)
                for p in range(PARTS):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    np.add.at(n[p], codes[:, p], 1)
        part, entry = np.nonzero(n)
        yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry], "sums": list(total[part, entry])})

    sums = coded.select("v", "code").mapInPandas(fold, "part int, entry int, n long, sums array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for part, entry, n, *s in sums.collect():
        out[part, entry] = [x // n for x in s]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """(id, keep columns, code, error) of each vector that is kept, and the codebooks, (PARTS, entries, width)."""
    rows = materialise(integers(vectors, id_col, vec_col, list(keep)).withColumn("code", F.lit(None).cast("binary")), "integers")
    first = rows.orderBy(F.col("id").isNull(), "id", "v").select("v").limit(ENTRIES).toPandas()
    if not len(first):
        return rows.select("id", *keep, "code", F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    books = np.ascontiguousarray(_parts(first).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        rows = materialise(assign(rows, books), "codes")
        books = means(rows, books)
    return materialise(assign(rows, books).drop("v"), "codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows, books = compress(vectors, keep=("label",))
    # the label as text, so that nulls are a group of their own
    rows = rows.withColumn("name", F.coalesce(F.col("label").cast("string"), F.lit(" ")))
    sums = rows.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_grouped(rows, sums, "name", "n", rows.count(), ["id"])
    text = ",".join(str(x) for x in books.ravel().tolist())
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds written one after the other: assignments a0, a1, ... from codebooks b0, b1, ..."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "cut AS (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS p(part))",
        "b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id)) - 1 AS entry, x AS y FROM cut QUALIFY entry < 256)",
    ]
    for i in range(ROUNDS + 1):
        # |x|^2 - 2 x.y + |y|^2, all whole numbers below 2^53
        steps.append(f"""a{i} AS (SELECT vec_id, part, any_value(x) AS x, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
  SELECT vec_id, c.part, c.x, b.entry, (list_inner_product(x::DOUBLE[], x::DOUBLE[]) - 2 * list_inner_product(x::DOUBLE[], y::DOUBLE[]) + list_inner_product(y::DOUBLE[], y::DOUBLE[]))::BIGINT AS d
  FROM cut c JOIN b{i} b USING (part)) GROUP BY vec_id, part)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS y FROM (
  SELECT part, entry, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{i}, range(1, 17) AS r(i) GROUP BY part, entry, i) GROUP BY part, entry)""")
            steps.append(f"b{i + 1} AS (SELECT part, entry, coalesce(m.y, b.y) AS y FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


ORACLE_SQL = _oracle()
