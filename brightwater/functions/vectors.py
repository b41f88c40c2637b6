"""Vector expressions over array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column, floor: float = 1e-12) -> Column:
    norm = F.greatest(l2_norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / norm)


def check_dimension(v: Column, dim: int) -> Column:
    """The vector, or an error that names both lengths."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))
