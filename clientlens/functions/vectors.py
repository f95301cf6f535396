"""Vector Column helpers (ARR-02/03) as higher-order SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """Unit-length vector; the zero vector stays zero (ARR-03)."""
    n = l2_norm(a)
    return F.transform(col_(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b); NULL when either vector has zero length (ARR-02)."""
    return F.lit(1.0) - F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))
