"""Fixed-length vector arithmetic over ``ARRAY<DOUBLE>`` columns.

Components are addressed one by one rather than through lambda functions, so that
the expressions take part in whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add as _plus

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE_MAX = 1.7976931348623157e308


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a composite expression that is evaluated once instead of once per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vector(*components: Column | float) -> Column:
    return F.array(*[
        (c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in components
    ])


def parts(v: Column, size: int = 3) -> list[Column]:
    return [v[i] for i in range(size)]


def total(columns: list[Column]) -> Column:
    return reduce(_plus, columns)


def add(a: Column, b: Column, size: int = 3) -> Column:
    return F.array(*[a[i] + b[i] for i in range(size)])


def subtract(a: Column, b: Column, size: int = 3) -> Column:
    return F.array(*[a[i] - b[i] for i in range(size)])


def scale(v: Column, factor: Column | float, size: int = 3) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.array(*[v[i] * factor for i in range(size)])


def dot(a: Column, b: Column, size: int = 3) -> Column:
    return total([a[i] * b[i] for i in range(size)])


def cross(a: Column, b: Column) -> Column:
    return F.array(
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(v: Column, size: int = 3) -> Column:
    return F.sqrt(dot(v, v, size))


def stable_norm(v: Column, size: int = 3) -> Column:
    """Euclidean norm scaled by the largest component; non-finite input gives infinity."""
    magnitude = F.greatest(*[F.abs(v[i]) for i in range(size)])
    ratio = F.sqrt(total([(v[i] / magnitude) * (v[i] / magnitude) for i in range(size)]))
    return (
        F.when(~all_finite(v, size), F.lit(float("inf")))
        .when(magnitude == 0.0, F.lit(0.0))
        .otherwise(magnitude * ratio)
    )


def distance(a: Column, b: Column, size: int = 3) -> Column:
    return norm(subtract(a, b, size), size)


def normalise(v: Column, fallback: Column | None = None, epsilon: float = 0.0, size: int = 3) -> Column:
    """Unit vector; a vector no longer than ``epsilon`` becomes ``fallback`` (zeros by default)."""
    length = norm(v, size)
    fallback = vector(*[0.0] * size) if fallback is None else fallback
    return F.when(length <= epsilon, fallback).otherwise(
        F.array(*[v[i] / length for i in range(size)])
    )


def is_finite(value: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(value.between(-DOUBLE_MAX, DOUBLE_MAX), F.lit(False))


def all_finite(v: Column, size: int = 3) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(v[i]) for i in range(size)])


def fold_negative_zero(value: Column) -> Column:
    return value + F.lit(0.0)


def lerp(left: Column, right: Column, fraction: Column, size: int) -> Column:
    return F.array(*[(1.0 - fraction) * left[i] + fraction * right[i] for i in range(size)])
