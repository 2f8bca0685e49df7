"""Scalar column expressions.

Everything here is a native Catalyst expression, so it stays inside
whole-stage codegen; nothing is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Column by name, back-quoted (names may hold spaces, '+', '/', digits)."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip_unit(c, unit: str) -> Column:
    """Remove every occurrence of ``unit``, trim, parse; non-numeric -> NULL."""
    return F.trim(F.replace(col(c).cast("string"), F.lit(unit), F.lit(""))).try_cast("double")


def safe_ratio(num, den, scale: float = 1.0) -> Column:
    """scale*num/den with +-inf and NaN (x/0, 0/0, NULL operand) mapped to 0."""
    return F.coalesce(F.try_divide(F.lit(float(scale)) * col(num), col(den)), F.lit(0.0))


def ratio_or_null(num, den, scale: float = 1.0) -> Column:
    """Ratio that is NULL (not an error, not 0) on a zero denominator."""
    return F.try_divide(F.lit(float(scale)) * col(num), col(den))


def rescale(c, k: float) -> Column:
    """Divide by a unit (e.g. 1e6)."""
    return col(c) / F.lit(float(k))


def occurred(c) -> Column:
    """1 when the count is positive."""
    return (F.coalesce(col(c), F.lit(0)) > 0).cast("int")


def binarize(c, threshold: float = 0.5) -> Column:
    """P20: 1 when strictly above the threshold."""
    return (col(c) > F.lit(threshold)).cast("int")


def residual(y, p, convention: str = "true_minus_pred") -> Column:
    """Signed residual in either convention, or the absolute error."""
    if convention == "true_minus_pred":
        return col(y) - col(p)
    if convention == "pred_minus_true":
        return col(p) - col(y)
    if convention == "abs":
        return F.abs(col(p) - col(y))
    raise ValueError(convention)


# --- fixed value: the reference's SMAPE denominator guard ---------------------
SMAPE_EPS = 1e-10


def smape_term(y, p) -> Column:
    """E2 row term: 2|p-y| / (|y|+|p|+1e-10); ``100*avg`` of it is SMAPE in 0..200."""
    return F.lit(2.0) * F.abs(col(p) - col(y)) / (F.abs(col(y)) + F.abs(col(p)) + F.lit(SMAPE_EPS))


def smape(y, p) -> Column:
    """E2 as an aggregate column."""
    return F.lit(100.0) * F.avg(smape_term(y, p))
