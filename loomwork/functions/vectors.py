"""Vector expressions on arrays, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: over the query's token vectors, the sum of the largest dot product with a document token."""
    return F.aggregate(
        F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x
    )
