"""Panel filters (F1-F8) and aggregates.

Aggregates are single ``groupBy().agg()`` calls so Spark plans one partial
(map-side) aggregate and one exchange per key; a hot key costs one partial row
per task, not a third of the data in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import iso_week, to_day, week_year
from ..functions.exact import exact_mean, exact_sum
from ..functions.exprs import col


# ---------------------------------------------------------------- filters ---

def eq_filter(df: DataFrame, c: str, v) -> DataFrame:
    """keep rows where c = v (NULL drops)."""
    return df.where(col(c) == F.lit(v))


def contains_filter(df: DataFrame, c: str, s: str) -> DataFrame:
    """substring match; NULL is false."""
    return df.where(F.coalesce(col(c).cast("string").contains(s), F.lit(False)))


def exclude(df: DataFrame, c: str, values, keep_null: bool = True) -> DataFrame:
    """``NOT IN`` a short list; NULL keys are kept (pandas ``~isin`` semantics).

    For a long list, pass a DataFrame of keys: it becomes a left-anti join
    (NULL keys never match, so they are kept too).
    """
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("_excl_key")).distinct()
        return df.join(keys, col(c) == F.col("_excl_key"), "left_anti")
    cond = ~col(c).isin(list(values))
    if keep_null:
        cond = cond | col(c).isNull()
    return df.where(cond)


def exclude_listed(df: DataFrame, c: str, listed: DataFrame, key: str | None = None) -> DataFrame:
    """F3 with a list of any length: rows whose value stands in the table ``listed`` go; a NULL value goes only where
    the table lists NULL."""
    names = listed.select(col(key or c).alias("_el_key")).distinct()
    return df.join(names, col(c).eqNullSafe(F.col("_el_key")), "left_anti")


def week_between(df: DataFrame, lo: int, hi: int, week: str = "week") -> DataFrame:
    """inclusive week range."""
    return df.where(col(week).between(lo, hi))


def drop_null(df: DataFrame, cols) -> DataFrame:
    """drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def distinct_on(df: DataFrame, cols) -> DataFrame:
    """distinct rows of a column subset."""
    return df.select(*[col(c) for c in cols]).distinct()


def below(df: DataFrame, c: str, t: float) -> DataFrame:
    """strict upper threshold on a metric."""
    return df.where(col(c) < F.lit(t))


def from_week(df: DataFrame, k: int, week: str = "week") -> DataFrame:
    """F8: weeks from ``k`` on; written partitioned by week instead of a per-week loop."""
    return df.where(col(week) >= F.lit(k))


# ------------------------------------------------------------ aggregates ---

def with_week_key(df: DataFrame, date: str, iso_year: bool = False,
                  year: str = "year", week: str = "week") -> DataFrame:
    """P2 on a frame: (year, week) columns, calendar year unless ``iso_year``."""
    d = to_day(date)
    return df.withColumns({year: week_year(d, iso_year), week: iso_week(d)})


def weekly_rollup(df: DataFrame, keys, means=(), sums=(), exposure: str | None = None,
                  exposure_mode: str = "sum", exposure_name: str | None = None) -> DataFrame:
    """A1-A3: one row per key; mean of ``means``, sum of ``sums`` (all-NULL -> 0).

    Rows with a NULL key are dropped (pandas ``groupby`` default). Exposure is
    summed (A2) or taken as 7 x the daily mean (A3), in the same aggregate so
    the panel is shuffled once.
    """
    keys = list(keys)
    aggs: list[Column] = [F.avg(col(c)).alias(c) for c in means]
    for c in sums:
        aggs.append(F.coalesce(F.sum(col(c)), F.lit(0)).alias(c))
    if exposure is not None:
        name = exposure_name or ("exposure_sum" if exposure_mode == "sum" else "exposure_mean7")
        if exposure_mode == "sum":
            aggs.append(F.coalesce(F.sum(col(exposure)), F.lit(0.0)).alias(name))
        elif exposure_mode == "mean7":
            aggs.append((F.avg(col(exposure)) * F.lit(7.0)).alias(name))
        else:
            raise ValueError(exposure_mode)
    not_null = None
    for k in keys:
        cond = col(k).isNotNull()
        not_null = cond if not_null is None else (not_null & cond)
    return df.where(not_null).groupBy(*[col(k) for k in keys]).agg(*aggs)


def cell_totals(df: DataFrame, key: str, c: str, total: str = "total", mean: str = "mean") -> DataFrame:
    """A4: per-cell sum and mean, the same for any order of the rows."""
    return df.groupBy(col(key)).agg(exact_sum(c).alias(total), exact_mean(c).alias(mean))


def deduped_total(df: DataFrame, key: str, date: str, c: str, name: str = "total") -> DataFrame:
    """A5: per-cell sum over distinct (key, date, c) rows.

    The distinct runs as an aggregate on (key, date, c); its partial step
    removes copies inside each task before the exchange.
    """
    return (df.select(col(key), col(date), col(c)).distinct()
              .groupBy(col(key)).agg(F.sum(col(c)).alias(name)))


def cell_mean(df: DataFrame, key: str, cols, suffix: str = "") -> DataFrame:
    """Per-cell means of one or many columns, the same for any order of the rows."""
    return df.groupBy(col(key)).agg(*[exact_mean(c).alias(f"{c}{suffix}") for c in cols])


def distinct_values(df: DataFrame, c: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct count of a column (exact, or HyperLogLog++ at scale)."""
    f = F.approx_count_distinct(col(c), rsd) if approx else F.count_distinct(col(c))
    return df.agg(f.alias("n_distinct"))


def sorted_distinct(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col(c)).distinct().orderBy(col(c))


def global_mean(df: DataFrame, c: str, name: str = "mean") -> DataFrame:
    """A10: one-row mean line, the same for any order of the rows."""
    return df.agg(exact_mean(c).alias(name))
