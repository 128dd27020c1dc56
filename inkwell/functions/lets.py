"""Column helpers used all over the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def explode(values: Column) -> Column:
    """One row for each element; empty arrays give a null, which the caller drops.

    The plain ``explode`` has Spark test the array for null and for size below it, which works out the whole expression three times.
    """
    return F.explode_outer(values)


def posexplode(values: Column) -> Column:
    return F.posexplode_outer(values)


def round_half_away(value: Column, places: int) -> Column:
    """Scale, round half away from zero, scale back, all in binary floating point (``round`` goes through decimals)."""
    f = float(10**places)
    return F.signum(value) * F.floor(F.abs(value) * f + 0.5) / f


def merged(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two frames as large as the vocabulary: packed files look small, but neither may be gathered on the driver to be broadcast."""
    return a.hint("merge").join(b.hint("merge"), on, how)
