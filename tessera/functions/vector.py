"""Vector arithmetic on array<double> columns, as expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def clean(a: Column) -> Column:
    """NaN and null elements as 0."""
    return F.transform(a, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """NaN elements count as 0; with a zero vector the similarity is minus infinity."""
    a, b = clean(a), clean(b)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("-inf"))).otherwise(dot(a, b) / size)


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # the length as an array's element, so that it is computed once, not anew for each element
    return F.transform(F.array(norm(a)), lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n)))[0]


def fit_length(a: Column, size: int) -> Column:
    """Cut or padded with zeros to ``size``; null becomes all zeros."""
    padded = F.concat(F.coalesce(as_doubles(a), F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), size))
    return F.slice(padded, 1, size)


def cosine_of_unit_distance(d: Column) -> Column:
    """Cosine of two unit vectors at Euclidean distance ``d``."""
    return 1 - d * d / 2


def features(scalars: list[Column], vector: Column, size: int) -> Column:
    """Scalars (null as 0) followed by the vector cut or padded to ``size``."""
    head = F.array(*[F.coalesce(s.cast("double"), F.lit(0.0)) for s in scalars])
    return F.concat(head, fit_length(vector, size))
