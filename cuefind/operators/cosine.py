"""Cosine similarity of two vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_similarity(a: Column, b: Column) -> Column:
    """Scalar cosine similarity in double (null for a zero vector) as a JVM expression."""
    product = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda total, v: total + v)
    return F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b)))
