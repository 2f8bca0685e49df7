"""Exposure-adjusted risk measures (R1-R8): named compositions of the panel ops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, occurred, ratio_or_null, rescale, safe_ratio
from ..session import cut_lineage
from . import joins, panel


def weekly_risk(day_panel: DataFrame, *, cell: str = "grid", date: str = "date",
                accident: str = "accident", exposure: str = "exposure", features=(),
                scale: float = 1000.0, mode: str = "sum", risk_name: str = "risk",
                exclude_cells=(), iso_year: bool = False) -> DataFrame:
    """Weekly panel (cell, year, week) with feature means, accident sum,
    exposure, ``risk`` = scale*accidents/exposure (0 when undefined) and the
    0/1 ``occurrence`` label.

    The exclusion is applied to the daily rows: ``cell`` is a grouping key, so
    it is the same rows as excluding weekly rows, and the predicate reaches
    the scan.  Plan: scan -> partial aggregate -> one exchange on
    (cell, year, week) -> final aggregate -> project.
    """
    src = panel.exclude(day_panel, cell, exclude_cells) if exclude_cells else day_panel
    keyed = panel.with_week_key(src, date, iso_year=iso_year)
    exp_name = "exposure"
    weekly = panel.weekly_rollup(keyed, [cell, "year", "week"], means=features, sums=[accident],
                                 exposure=exposure, exposure_mode=mode, exposure_name=exp_name)
    return weekly.withColumns({
        risk_name: safe_ratio(accident, exp_name, scale),
        "occurrence": occurred(accident),
    })


def annual_risk(day_panel: DataFrame, *, cell: str = "grid", date: str = "date",
                accident: str = "accident", exposure: str = "exposure") -> DataFrame:
    """R4 with its parts (A4, A5): accidents over distinct (cell, date, accident)
    rows divided by total exposure; NULL when the exposure is 0 (the reference
    divides unguarded)."""
    acc = panel.deduped_total(day_panel, cell, date, accident, name="accidents")
    vol = panel.cell_totals(day_panel, cell, exposure, total="total_exposure", mean="mean_exposure")
    out = joins.risk_join([acc, vol], cell)
    return out.withColumn("annual_risk", ratio_or_null("accidents", "total_exposure"))


def daily_ratio(day_panel: DataFrame, accident: str = "accident", exposure: str = "exposure",
                scale: float = 100.0, name: str = "daily_risk") -> DataFrame:
    """P13 per row: safe ``scale * accident / exposure``."""
    return day_panel.withColumn(name, safe_ratio(accident, exposure, scale))


def mean_risk(day_panel: DataFrame, *, level: str = "day", cell: str = "grid", date: str = "date",
              accident: str = "accident", exposure: str = "exposure",
              reference_compat: bool = False) -> DataFrame:
    """R5 (level='day'): mean over days of the safe daily ratio (%).
    R6 (level='week'): mean over weeks of the weekly ratio R2; with
    ``reference_compat`` the reference's form, which equals R5."""
    if level == "day" or reference_compat:
        name = "mean_daily_risk" if level == "day" else "mean_weekly_risk"
        return (daily_ratio(day_panel, accident, exposure)
                .groupBy(col(cell)).agg(F.avg("daily_risk").alias(name)))
    if level != "week":
        raise ValueError(level)
    weekly = weekly_risk(day_panel, cell=cell, date=date, accident=accident,
                         exposure=exposure, scale=100.0, risk_name="weekly_risk")
    return weekly.groupBy(col(cell)).agg(F.avg("weekly_risk").alias("mean_weekly_risk"))


def risk_surface(day_panel: DataFrame, *, cell: str = "grid", date: str = "date",
                 accident: str = "accident", exposure: str = "exposure",
                 reference_compat: bool = False, materialize: bool = True) -> DataFrame:
    """One row per cell with accidents, total/mean exposure, R4, R5, R6,
    exposure in millions and log1p of accidents and exposure.

    The day panel is read by three aggregates (deduplicated accidents; exposure
    sums with the mean daily ratio in one pass; the weekly ratios), so its
    four needed columns are materialised once (checkpoint) unless
    ``materialize=False``.  All aggregates are keyed by ``cell`` and the joins
    reuse that partitioning.
    """
    src = day_panel.select(col(cell), col(date), col(accident), col(exposure))
    if materialize:
        src = cut_lineage(src)
    acc = panel.deduped_total(src, cell, date, accident, name="accidents")
    per = src.groupBy(col(cell)).agg(F.sum(col(exposure)).alias("total_exposure"),
                                     F.avg(col(exposure)).alias("mean_exposure"),
                                     F.avg(safe_ratio(accident, exposure, 100.0)).alias("mean_daily_risk"))
    if reference_compat:
        per = per.withColumn("mean_weekly_risk", F.col("mean_daily_risk"))
        parts = [acc, per]
    else:
        parts = [acc, per, mean_risk(src, level="week", cell=cell, date=date, accident=accident, exposure=exposure)]
    out = joins.risk_join(parts, cell)
    return out.withColumns({
        "annual_risk": ratio_or_null("accidents", "total_exposure"),
        "exposure_millions": rescale("total_exposure", 1e6),
        "log_exposure": F.log1p(F.col("total_exposure")),
        "log_accidents": F.log1p(F.col("accidents")),
    })


def map_layer(weekly: DataFrame, *, keys=("grid", "year", "week"), cell: str = "grid", week: str = "week",
              actual: str = "actual", pred: str = "predicted", geo: DataFrame | None = None,
              min_week: int | None = None) -> DataFrame:
    """Actual and predicted per cell-week with the shared colour bounds
    (min/max over both columns, A9) attached; optionally joined to geometry
    (J3, all cells kept, missing values 0).  ``weekly`` is the whole panel with
    the predictions written back: the bounds are taken over all its weeks, and
    only then the weeks from ``min_week`` on are kept.  Written with
    ``partitionBy(week)`` instead of one file per week in a loop."""
    layer = weekly.select(*[col(k) for k in keys], col(actual), col(pred))
    bounds = layer.agg(F.min(F.least(col(actual), col(pred))).alias("vmin"),
                       F.max(F.greatest(col(actual), col(pred))).alias("vmax"))
    if min_week is not None:
        layer = panel.from_week(layer, min_week, week)
    layer = layer.crossJoin(F.broadcast(bounds))  # one row: a proven size bound
    if geo is not None:
        layer = joins.attach_geometry(geo, layer, on=cell)
    return layer
