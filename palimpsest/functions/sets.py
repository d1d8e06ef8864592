"""Set functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct values; 1 if both are empty, 0 if one is."""
    na, nb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(common / (na + nb - common))


def text_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))
