"""Vector distances as Catalyst expressions, accumulated in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, v) -> s + v)"
L2 = f"sqrt({_SUM.format('(x - y) * (x - y)')})"
INNER = _SUM.format("x * y")
NORM = "sqrt(aggregate(a, 0D, (s, v) -> s + v * v))"

#: SQL functions by name: parameters and body. Dialects name the same two distances differently.
SQL_FUNCTIONS = {
    "l2_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", L2),
    "L2Distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", L2),
    "distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", L2),
    "inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", INNER),
    "neg_inner_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", f"-({INNER})"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", f"1D - ({INNER}) / nullif({NORM} * {NORM.replace('(a,', '(b,')}, 0D)"),
    "l2_norm": ("a ARRAY<DOUBLE>", NORM),
}


#: What distance() computes, by the metric of a vector index.
BY_METRIC = {"l2": "l2_distance", "cosine": "cosine_distance", "ip": "neg_inner_product"}


def register(spark: SparkSession, metric: str = "l2") -> None:
    """Makes the distances callable from SQL. Catalyst inlines them. metric: what distance() stands for."""
    for name, (params, body) in (SQL_FUNCTIONS | {"distance": SQL_FUNCTIONS[BY_METRIC[metric]]}).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS DOUBLE RETURN {body}")


def vector(values: Sequence[float]) -> Column:
    """A typed array<float> literal."""
    return F.lit(np.asarray(values, np.float32))


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.lit(1.0) - inner_product(a, b) / F.when(size != 0, size)


DISTANCES = {"l2": l2, "ip": lambda a, b: -inner_product(a, b), "cosine": cosine_distance}


def resize(v: Column, dim: int) -> Column:
    """Padded with zeros or cut to dim elements."""
    return F.slice(F.concat(v.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def check_dim(v: Column, dim: int) -> Column:
    """v, or an error at run time where it doesn't have dim elements."""
    return F.when(F.assert_true(F.size(v) == dim).isNull(), v)
