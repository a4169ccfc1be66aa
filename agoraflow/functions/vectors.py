"""Vector and set expressions on array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector is returned as it is."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side is a zero vector."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word lists, case-folded; 0 when both are empty."""
    la, lb = F.transform(a, F.lower), F.transform(b, F.lower)
    union = F.size(F.array_union(la, lb))
    return F.when(union > 0, F.size(F.array_intersect(la, lb)) / union).otherwise(F.lit(0.0))
