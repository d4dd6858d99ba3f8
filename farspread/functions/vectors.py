"""Column expressions over array<double> features: all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, mode: str = "l2") -> Column:
    """v over its length; a zero vector stays. mode 'none' leaves all vectors."""
    if mode == "none":
        return v
    if mode != "l2":
        raise ValueError(f"unknown normalisation {mode!r}: 'l2' or 'none'")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def checked(v: Column, width: int) -> Column:
    """v, or an error for a wrong width or a value that isn't finite."""
    good = (F.size(v) == width) & is_finite(v)
    return F.when(good, v).otherwise(F.raise_error(F.lit(f"features must be {width} finite numbers")))
