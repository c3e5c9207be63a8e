"""Vector expressions (H26, H27) evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    """Euclidean norm, summed left to right in double."""
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """V / |v|; the zero vector stays zero."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def fixed_point(v: Column, scale: float = 1e6) -> Column:
    """Comma-joined ``round(x * scale)`` integers: a type-neutral text form of a vector."""
    return F.array_join(F.transform(v, lambda x: F.round(x * scale).cast("bigint").cast("string")), ",")
