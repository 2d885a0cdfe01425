"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def present(a: Column) -> Column:
    """A vector that can be ranked."""
    return a.isNotNull() & (F.size(a) > 0)


def half_cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """(1 + cosine) / 2, the usual score of a vector index."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    return (1 + F.try_divide(dot(a, b), na * nb)) / 2


def flat(a: Column, depth: int = 1) -> Column:
    """A vector that came wrapped in ``depth`` - 1 outer arrays, as one array of floats; lengths are left as they are."""
    for _ in range(depth - 1):
        a = F.flatten(a)
    return a.cast("array<float>")
