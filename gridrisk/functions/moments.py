"""Mergeable moments: (n, mean, m2) as a struct, m2 being the sum of squares about the mean.

Two sets' moments merge, and a part's are taken out of a whole's, by Chan's formulas on differences of means.
Sums of squares are never subtracted from one another, which cancels where the mean is large against the
deviation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col


def _struct(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.cast("double").alias("n"), mean.alias("mean"), m2.alias("m2"))


def moments(c) -> Column:
    """Aggregate: the moments of the known values (mean NULL and m2 0 without any)."""
    x = col(c).cast("double")
    return _struct(F.count(x), F.avg(x), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)))


def without(whole: Column, part: Column) -> Column:
    """Moments of what is in ``whole`` and not in ``part``."""
    n = whole["n"] - part["n"]
    off = F.coalesce(part["mean"] - whole["mean"], F.lit(0.0))  # a part without values
    mean = whole["mean"] - F.try_divide(part["n"] * off, n)
    rest = whole["m2"] - part["m2"] - F.coalesce(F.try_divide(whole["n"] * part["n"] * off * off, n), F.lit(0.0))
    return _struct(n, mean, F.greatest(rest, F.lit(0.0)))


def filled(m: Column, rows: Column) -> Column:
    """Moments of the column once its NULLs are filled with the mean, ``rows`` values in all."""
    return _struct(rows, m["mean"], m["m2"])


def scale_of(m: Column) -> Column:
    """Population deviation; 1 where it is 0 or there is no value."""
    std = F.sqrt(F.try_divide(m["m2"], m["n"]))
    return F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(std)
