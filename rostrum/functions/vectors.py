"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(x: str | Column) -> Column:
    return _col(x).cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def neg_squared_l2(a: str | Column, b: str | Column) -> Column:
    """Negative squared distance, so that higher is better as with the dot product."""
    return -total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column, eps: float = EPS) -> Column:
    return let(norm(a) + F.lit(eps), lambda length: F.transform(_col(a), lambda v: v / length))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)
