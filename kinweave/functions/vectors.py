"""Vector expressions on arrays of numbers; the sums are folds inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine, or NULL for different lengths, no length, NULL elements or a zero vector."""
    a, b = _column(a), _column(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2; 0 where there is no cosine, NULL if a vector is NULL."""
    a, b = _column(a), _column(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce((cosine(a, b) + 1) / 2, F.lit(0.0)))


def weighted_average(current: Column | str, count: Column | str, new: Column | str, weight: Column | str) -> Column:
    """(current * count + new * weight) / (count + weight); the new vector if there is no current one."""
    current, count, new, weight = map(_column, (current, count, new, weight))
    mean = F.zip_with(current, new, lambda c, n: (c.cast("double") * count + n.cast("double") * weight) / (count + weight))
    return F.when(current.isNull() | (count <= 0), F.transform(new, lambda x: x.cast("double"))).otherwise(mean)
