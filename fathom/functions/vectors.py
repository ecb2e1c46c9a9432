"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMS = 8192


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0).cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors and vectors of different length."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def literal(vector: list[float]) -> Column:
    if not 1 <= len(vector) <= MOST_DIMS:
        raise ValueError(f"a vector needs 1 to {MOST_DIMS} dimensions")
    return F.lit([float(x) for x in vector]).cast("array<double>")
