"""Search as a table function: ``nearest(TABLE(rows), 'vector', query, k, 'key')`` in SQL.

The table argument takes any table or subquery, so predicates of the subquery are applied (and pushed to the scan) before the
search. Each task keeps k rows and gives them at its end; ORDER BY distance, key LIMIT k of the
statement makes the final cut, in which Spark sees k rows a task:

    SELECT id, distance FROM nearest(TABLE(SELECT id, v FROM docs WHERE year > 1990), 'v', array(0.1, 0.2), 5, 'id')
    ORDER BY distance, id LIMIT 5

Results are the columns of the table and distance, a double. Rows whose vector is null, has another length than the query, or
whose distance isn't finite have no part; ties go by key, nulls first. An empty table gives no rows. Wrong arguments are told when the statement is
analysed: no such column, not a column of numbers, k not a positive constant, a column that is called distance already.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .knn import _distances

NUMBERS = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType, T.DecimalType)
METRICS = ("l2", "cosine", "ip")
#: Rows whose distances are computed at once.
BLOCK = 1024


def _constant(arg: AnalyzeArgument | None, name: str, kind: type):
    if arg is None or not arg.isConstantExpression or not isinstance(arg.value, kind) or isinstance(arg.value, bool):
        raise ValueError(f"{name} must be a constant of type {kind.__name__}")
    return arg.value


def _is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, NUMBERS)


@dataclass
class Found(AnalyzeResult):
    """What analysis found: the constant arguments, for the tasks."""

    vector: str = ""
    key: str = ""
    k: int = 0
    metric: str = "l2"


class Nearest:
    """The handler; one instance reads one partition of the table."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, vector: AnalyzeArgument, query: AnalyzeArgument, k: AnalyzeArgument, key: AnalyzeArgument, metric: AnalyzeArgument | None = None) -> Found:
        if not rows.isTable:
            raise ValueError("the first argument must be a table: TABLE(name) or TABLE(SELECT ...)")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        vec, by = _constant(vector, "the vector column", str), _constant(key, "the key column", str)
        for name in (vec, by):
            if name not in kinds:
                raise ValueError(f"the table has no column {name}; it has {', '.join(kinds)}")
        if not _is_vector(kinds[vec]):
            raise ValueError(f"{vec} is not an array of numbers")
        if not _is_vector(query.dataType):
            raise ValueError("the query must be an array of numbers")
        if _constant(k, "k", int) < 1:
            raise ValueError("k must be positive")
        if metric is not None and _constant(metric, "the metric", str) not in METRICS:
            raise ValueError(f"the metric must be one of {', '.join(METRICS)}")
        if "distance" in kinds:
            raise ValueError("the table has a column called distance")
        # names and types only: metadata such as an event time's doesn't outlive the cut
        fields = [T.StructField(f.name, f.dataType) for f in rows.dataType.fields]
        measure = "l2" if metric is None else metric.value
        return Found(T.StructType([*fields, T.StructField("distance", T.DoubleType())]), vector=vec, key=by, k=k.value, metric=measure)

    def __init__(self, found: Found):
        self.found = found
        self.query: np.ndarray | None = None
        self.held: list[Row] = []
        self.best: list[tuple] = []

    def eval(self, rows: Row, vector, query, k, key, metric=None):
        if self.query is None:
            self.query = np.array([] if query is None or None in query else query, float)
        v = rows[self.found.vector]
        if v is not None and len(v) == len(self.query) > 0 and None not in v:
            self.held.append(rows)
            if len(self.held) == BLOCK:
                self._measure()

    def _measure(self) -> None:
        flat = np.array([[float(x) if isinstance(x, Decimal) else x for x in r[self.found.vector]] for r in self.held], float)
        with np.errstate(invalid="ignore", over="ignore"):
            distances = _distances(flat, self.query[None, :], self.found.metric)[:, 0]
        near = [(float(d), r) for d, r in zip(distances, self.held) if np.isfinite(d)]
        self.held = []
        self.best = heapq.nsmallest(self.found.k, [*self.best, *near], key=self._rank)

    def _rank(self, candidate: tuple) -> tuple:
        distance, row = candidate
        value = row[self.found.key]
        return (distance, False) if value is None else (distance, True, value)

    def terminate(self):
        if self.held:
            self._measure()
        for distance, row in self.best:
            yield (*row, distance)


nearest = F.udtf(Nearest, useArrow=True)


def register(spark: SparkSession, name: str = "nearest") -> None:
    """Makes the function known to SQL statements of the session."""
    spark.udtf.register(name, nearest)


def nearest_rows(df: DataFrame, vec_col: str, query: list[float], k: int, key: str, metric: str = "l2") -> DataFrame:
    """The k rows nearest to query, with distance: the function over a frame, and the final cut."""
    args = (F.lit(vec_col), F.lit([float(x) for x in query]), F.lit(k), F.lit(key), F.lit(metric))
    return nearest(df.asTable(), *args).orderBy("distance", F.asc_nulls_first(key)).limit(k)
