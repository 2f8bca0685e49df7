"""Feature construction and projections (P2-P7 on frames, P14, P16-P18, C2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.exprs import col


def calendar_parts(df: DataFrame, date: str, holidays=cal.REFERENCE_HOLIDAYS, recurring=None,
                   iso_year: bool = False) -> DataFrame:
    """Weekday (Monday 0), day of month, month, weekend, season,
    holiday flag, ISO week and (calendar) year, all in one projection."""
    d = cal.to_day(date)
    return df.withColumns({
        "day_of_week": cal.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "month": F.month(d),
        "weekend": cal.is_weekend(d),
        "season": cal.season(d),
        "is_holiday": cal.is_holiday(d, holidays, recurring),
        "week": cal.iso_week(d),
        "year": cal.week_year(d, iso_year),
    })


def season_dummies(df: DataFrame, date: str | None = None, season_col: str = "season") -> DataFrame:
    """One DOUBLE column per season, all four kept (``season_<name>``)."""
    s = cal.season(date) if date is not None else col(season_col)
    return df.withColumns({f"season_{name}": F.when(s == F.lit(name), F.lit(1.0)).otherwise(F.lit(0.0))
                           for name in sorted(cal.SEASONS)})


def log1p_cols(df: DataFrame, cols, prefix: str = "log_") -> DataFrame:
    """``log(1 + x)`` copies of columns."""
    return df.withColumns({f"{prefix}{c}": F.log1p(col(c)) for c in cols})


def group_columns(registry: dict, groups) -> list[str]:
    """Concatenate named groups, keeping the first of duplicated names."""
    return list(dict.fromkeys(c for g in groups for c in registry[g]))


def select_groups(df: DataFrame, registry: dict, groups, keep=()) -> DataFrame:
    """P16 on a frame: key columns plus the de-duplicated feature list."""
    cols = list(dict.fromkeys(list(keep) + group_columns(registry, groups)))
    return df.select(*[col(c) for c in cols])


def select_except(df: DataFrame, excluded) -> DataFrame:
    """Every column but ``excluded``."""
    ex = set(excluded)
    return df.select(*[col(c) for c in df.columns if c not in ex])


def blocks_by_pattern(columns, contains: dict, exact: dict | None = None) -> dict:
    """Block name -> columns (in frame order) whose name contains one of the
    block's substrings (case-sensitive) or equals one of its exact names.
    Blocks are independent: a column may fall in several.  Schema only."""
    exact = exact or {}
    out: dict[str, list[str]] = {}
    for name in list(dict.fromkeys(list(exact) + list(contains))):
        subs, names = contains.get(name, ()), set(exact.get(name, ()))
        out[name] = [c for c in columns if c in names or any(s in c for s in subs)]
    return out


def flag_days(df: DataFrame, date: str, days: DataFrame, day: str = "date", out: str = "is_holiday") -> DataFrame:
    """P7 with a calendar of any length: 1 on the dates of the table ``days``, else 0 (a NULL date too)."""
    listed = days.select(F.to_date(F.col(f"`{day}`")).alias("_fd_day")).distinct().withColumn("_fd_hit", F.lit(1))
    j = df.join(listed, F.to_date(F.col(f"`{date}`")) == F.col("_fd_day"), "left")
    return j.withColumn(out, F.coalesce("_fd_hit", F.lit(0))).drop("_fd_day", "_fd_hit")
