"""Column builders over arrays of doubles: sums, dot products, norms. They run inside a row and never shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: str | Column, f) -> Column:
    """f of a value that is computed once a row.

    A column used inside a lambda is put there as its whole expression and computed for every element; a bound one is not.
    """
    return F.element_at(F.transform(F.array(col(value)), f), 1)


def total(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v)


def mean(a: str | Column) -> Column:
    return safe(total(a), F.size(col(a)))


def safe(n: Column, d: Column) -> Column:
    """n / d, or 0 where d is 0 or null."""
    return F.coalesce(n / F.nullif(d.cast("double"), F.lit(0.0)), F.lit(0.0))


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def squares(a: str | Column) -> Column:
    return total(F.transform(col(a), lambda v: v * v))


def indexed(a: str | Column, f) -> Column:
    """Sum of f(value, position)."""
    return total(F.transform(col(a), lambda v, i: f(v, i.cast("double"))))


def variance(a: str | Column, sample: bool = False) -> Column:
    return let(a, lambda b: let(mean(b), lambda m: safe(total(F.transform(b, lambda v: (v - m) * (v - m))), F.size(b) - (1 if sample else 0))))


def frames(a: str | Column, width: int, hop: int) -> Column:
    """Array of complete frames of an array; none if it is shorter than a frame."""

    def cut(b):
        n = F.when(F.size(b) >= width, F.floor((F.size(b) - width) / hop).cast("int") + 1).otherwise(0)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(b, k * hop + 1, F.lit(width)))

    return let(a, cut)


def adjacent(a: str | Column, f) -> Column:
    """f(previous, current) for each pair of neighbours; empty below two values."""

    def pairs(b):
        n = F.greatest(F.size(b) - 1, F.lit(0))
        return F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, F.lit(2), n), f)

    return let(a, pairs)
