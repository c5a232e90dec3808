"""Vector expressions over ``ARRAY<FLOAT>`` columns, summed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(vector: Column | Sequence[float]) -> Column:
    """A column as given, or a list of numbers as an array literal."""
    if isinstance(vector, Column):
        return vector
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(left: Column, right: Column | Sequence[float]) -> Column:
    products = F.zip_with(
        left, as_vector(right), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column | Sequence[float]) -> Column:
    """Dot product over both lengths; null where a length is zero."""
    right = as_vector(right)
    lengths = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(lengths > 0, dot(left, right) / lengths)
