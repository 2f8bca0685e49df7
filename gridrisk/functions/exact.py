"""Sums of doubles that don't depend on the order of rows.

A double is written in balanced digits to the base 2**24 at fixed exponents.  Digits are whole numbers
under 2**24 in size, so their sums are exact in a long (up to 2**39 rows), whatever the order, the
partitions or the plan; the digit sums are put together once, from the smallest.  Values that have a known number
of decimals are summed as whole multiples of it instead (one long).

Every part is a built-in aggregate with a partial (map-side) step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col

BASE = 24
#: Exponents of the digits in units of ``BASE`` bits: values under 2**71 in size, resolved to 2**-72.
PLACES = (-3, -2, -1, 0, 1, 2)


def _digit(x: Column, place: int) -> Column:
    """The digit at ``place``: scaling by powers of two, ``rint`` and this difference are all exact."""
    return (F.rint(x * F.lit(2.0 ** (-BASE * place))) - F.lit(2.0 ** BASE) * F.rint(x * F.lit(2.0 ** (-BASE * (place + 1))))).cast("long")


def exact_sum(c) -> Column:
    """Aggregate: the sum of a numeric column, NULLs skipped (all NULL -> NULL).  Values below 2**-73 in size
    count as 0.  A value that isn't finite, or of 2**71 or more, makes it the plain ``sum``."""
    x = col(c).cast("double")
    ok = F.when(F.abs(x) < F.lit(2.0 ** 71), x)
    total = F.lit(0.0)
    for place in PLACES:
        total = total + F.sum(_digit(ok, place)).cast("double") * F.lit(2.0 ** (BASE * place))
    return F.when(F.count(x) == F.count(ok), total).otherwise(F.sum(x))


def exact_mean(c) -> Column:
    """Aggregate: ``exact_sum`` over the number of known values."""
    return F.try_divide(exact_sum(c), F.count(col(c)).cast("double"))


def scaled_sum(c, decimals: int) -> Column:
    """Aggregate: the sum of values that have at most ``decimals`` decimals, as one sum of whole numbers."""
    unit = float(10 ** decimals)
    return F.sum(F.rint(col(c).cast("double") * F.lit(unit)).cast("long")).cast("double") / F.lit(unit)


def scaled_mean(c, decimals: int) -> Column:
    return F.try_divide(scaled_sum(c, decimals), F.count(col(c)).cast("double"))
