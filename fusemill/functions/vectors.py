"""Vector arithmetic on array columns; the matrix path for large searches is in operators.dense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def squared_norm(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def reciprocal_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1e-6) + squared_distance(a, b))


def opposite_distance(a: Column, b: Column) -> Column:
    return -squared_distance(a, b)


def distance_similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def augmented_document(vector: Column, largest: Column) -> Column:
    """Prepend sqrt(largest squared norm - own squared norm): inner-product order becomes L2 order."""
    return F.concat(F.array(F.sqrt(F.greatest(largest - squared_norm(vector), F.lit(0.0)))), F.transform(vector, lambda x: x.cast("double")))


def augmented_query(vector: Column) -> Column:
    return F.concat(F.array(F.lit(0.0)), F.transform(vector, lambda x: x.cast("double")))
