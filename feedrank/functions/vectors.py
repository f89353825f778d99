"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns.

Elements are cast to DOUBLE before arithmetic, and sums run left to right so
results are reproducible across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def l2sq(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays."""
    def sq(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d
    return F.aggregate(F.zip_with(_c(a), _c(b), sq), F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm2(a) -> Column:
    return F.sqrt(dot(a, a))


def vec_dim(a) -> Column:
    return F.size(_c(a))


def fixed_vector(dim: int, value: float) -> Column:
    """A constant vector, e.g. a far-away sentinel centroid."""
    return F.array_repeat(F.lit(float(value)), dim)
