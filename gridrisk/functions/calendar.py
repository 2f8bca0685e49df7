"""Calendar expressions (P1-P7): Column -> Column, all native Spark SQL.

Fixed values that must equal the reference's for right results are gathered
at the top of the module.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (the reference's own lists) --------------------------------
# Season of a month: December-February winter, March-May spring,
# June-August summer, September-November fall.
SEASONS = ("winter", "spring", "summer", "fall")
# The reference's holiday list.
REFERENCE_HOLIDAYS = ("2022-01-01", "2022-12-25", "2022-12-26",
                      "2023-01-01", "2023-12-25", "2023-12-26")
# The same holidays as recurring (month, day) pairs.
RECURRING_HOLIDAYS = ((1, 1), (12, 25), (12, 26))
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def to_day(c) -> Column:
    """Parse a date string or truncate a timestamp to its date (ANSI: bad input raises)."""
    return F.to_date(_c(c))


def iso_week(c) -> Column:
    """ISO-8601 week number 1..53."""
    return F.weekofyear(_c(c))


def week_year(c, iso_year: bool = False) -> Column:
    """Calendar year by default (the reference's key), ISO year on request.

    The ISO year of a date is the calendar year of the Thursday of its week.
    """
    d = _c(c)
    if iso_year:
        return F.year(F.date_sub(d, F.weekday(d) - 3))
    return F.year(d)


def weekday(c) -> Column:
    """Monday = 0 .. Sunday = 6 (not ``dayofweek``, which is Sunday = 1)."""
    return F.weekday(_c(c))


def is_weekend(c) -> Column:
    """1 on Saturday/Sunday."""
    return (F.weekday(_c(c)) >= 5).cast("int")


def season(c) -> Column:
    """P5: month -> season label by ``month % 12 // 3`` (0 winter .. 3 fall)."""
    idx = (F.floor((F.month(_c(c)) % 12) / 3) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), idx)


def is_holiday(c, days=REFERENCE_HOLIDAYS, recurring=None) -> Column:
    """1 when the date is in ``days`` or matches a recurring (month, day) pair.

    A short list stays an ``IN`` predicate in generated code; a long calendar
    belongs in a table joined on the date.
    """
    d = F.to_date(_c(c))
    cond = F.lit(False)
    if days:
        cond = cond | d.isin([_dt.date.fromisoformat(x) if isinstance(x, str) else x for x in days])
    if recurring:
        md = F.month(d) * 100 + F.dayofmonth(d)
        cond = cond | md.isin([m * 100 + dd for m, dd in recurring])
    return F.coalesce(cond, F.lit(False)).cast("int")
