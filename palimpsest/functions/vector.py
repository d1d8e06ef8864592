"""Vector functions on array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is below TINY, null where a vector is null."""
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity that raises where lengths differ and gives NaN for a zero vector."""
    checked = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((norm(a) == 0) | (norm(b) == 0), F.lit(float("nan"))).otherwise(checked / (norm(a) * norm(b)))


def normalised(a: Column) -> Column:
    """a with non-finite values as 0, at unit length unless its norm is below TINY."""
    finite = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    n = norm(finite)
    return F.when(n < TINY, finite).otherwise(F.transform(finite, lambda x: x / n))


def resized(a: Column, size: int) -> Column:
    """a cut to `size` and normalised again, or filled up with zeros."""
    n = F.size(a)
    return F.when(n == size, a.cast("array<double>")).when(n > size, normalised(F.slice(a, 1, size))).otherwise(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - n))))


def literal(a: Column) -> Column:
    """[v1,v2,...] for export."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def clamped(x: Column) -> Column:
    """x within 0 and 1; NaN as 0."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))
