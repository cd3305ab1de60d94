"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_scale(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(a, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def axpy(by: Column, x: Column, y: Column) -> Column:
    """by * x + y"""
    return F.zip_with(x, y, lambda p, q: by * p + q)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) with x held within -20 and 20."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))
