"""Numeric expressions of evaluation: intervals, closeness, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(successes: Column, total: Column) -> Column:
    """struct<low, high>: the 95 % score interval of a rate; null without draws."""
    n, p = total.cast("double"), successes.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    scale = 1 + Z95 * Z95 / n
    center = (p + Z95 * Z95 / (2 * n)) / scale
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / scale
    return F.when(total > 0, F.struct((center - half).alias("low"), (center + half).alias("high")))


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two numbers are equal up to a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def half_even(x: Column, digits: int) -> Column:
    """A number rounded to digits, a tie of its decimal form to the even neighbour."""
    return F.bround(x, digits)


# The digits that costs, rewards and means are kept to.
DIGITS = {"cost": 8, "reward": 6, "mean": 2}
