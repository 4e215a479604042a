"""Column expressions over embedding arrays.

Sums run left to right in double precision over single-precision components, so a
score computed here, in the numpy tasks and in SQL is the same number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.functions.bind import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def l2_normalize(v: Column) -> Column:
    """Unit copy rounded to float; a zero vector stays zero."""

    def scaled(norm: Column) -> Column:
        inverse = F.when(norm == 0, F.lit(1.0)).otherwise(1.0 / F.when(norm == 0, 1.0).otherwise(norm))
        return let(
            inverse, lambda i: F.transform(v, lambda x: (x.cast("double") * i).cast("float"))
        )

    return let(l2_norm(v), scaled)


def dot(a: Column, b: Column) -> Column:
    """Inner product; different widths are an error, not a padded sum."""
    total = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("vector widths differ")).cast("double")
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def is_finite(v: Column) -> Column:
    """All components present and finite after conversion to float."""
    return F.forall(
        v,
        lambda x: x.isNotNull()
        & ~F.isnan(x.cast("float"))
        & (F.abs(x.cast("float")) < F.lit(float("inf")).cast("float")),
    )


def embedding_fault(
    v: Column, width: int, tolerance: float | None = settings.NORM_TOLERANCE
) -> Column:
    """Why ``v`` is not usable, or null. ``tolerance=None`` skips the unit-length test."""
    as_float = F.transform(v, lambda x: x.cast("float"))

    def judge(norm: Column) -> Column:
        fault = F.when(norm == 0, "zero")
        if tolerance is not None:
            fault = fault.when(F.abs(norm - 1.0) > tolerance, "not-unit")
        return fault

    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != width, "width")
        .when(~is_finite(v), "not-finite")
        .otherwise(let(l2_norm(as_float), judge))
    )


def is_valid_embedding(
    v: Column, width: int, tolerance: float | None = settings.NORM_TOLERANCE
) -> Column:
    return embedding_fault(v, width, tolerance).isNull()


def finite_or(value: Column, fallback) -> Column:
    """``value`` when it is a finite number, else ``fallback``."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, fallback).otherwise(value)
