"""Oracle-checked queries over the driver tables (SURVEY §2 'O' rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import exprs as fx
from ..operators import clean, evaluate, features, joins, panel, risk, scaling, split, stats
from ..operators import geo as geo_ops
from . import bindings as B
from .catalog import query, round_doubles
from .oracle import exact_mean, with_views

EXCL = ", ".join(str(c) for c in B.EXCLUDED_CELLS)


def _weekly(spark, d, scale=1000.0, mode="sum", name="risk"):
    p = B.risk_panel(spark, d)
    return risk.weekly_risk(p, features=B.PANEL_FEATURES, scale=scale, mode=mode,
                            risk_name=name, exclude_cells=B.EXCLUDED_CELLS)


_WEEKLY_SQL = f"""
SELECT grid, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
       round(avg(f_discount), 6) AS f_discount, round(avg(f_tax), 6) AS f_tax,
       round(avg(f_price), 6) AS f_price,
       CAST(coalesce(sum(accident), 0) AS BIGINT) AS accident,
       round(coalesce(sum(exposure), 0.0), 6) AS exposure,
       round(coalesce(1000.0 * coalesce(sum(accident), 0) / nullif(coalesce(sum(exposure), 0.0), 0), 0.0), 6) AS risk,
       CAST(coalesce(sum(accident), 0) > 0 AS INTEGER) AS occurrence
FROM risk_panel
WHERE grid IS NOT NULL AND date IS NOT NULL AND (grid NOT IN ({EXCL}) OR grid IS NULL)
GROUP BY 1, 2, 3"""


@query("weekly_risk", with_views(_WEEKLY_SQL, "risk_panel"))
def weekly_risk(spark, d):
    """R1 (A1+A2+P2+P13+P19+F3): accidents per 1000 units of exposure per cell-week."""
    return round_doubles(_weekly(spark, d))


# ------------------------------------------------------------- weekly forms ---

_PCT_SQL = f"""
SELECT grid, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
       CAST(coalesce(sum(accident), 0) AS BIGINT) AS accident,
       round({{exp}}, 6) AS exposure,
       round(coalesce(100.0 * coalesce(sum(accident), 0) / nullif({{exp}}, 0), 0.0), 6) AS risk_pct
FROM risk_panel
WHERE grid IS NOT NULL AND date IS NOT NULL AND (grid NOT IN ({EXCL}) OR grid IS NULL)
GROUP BY 1, 2, 3"""


@query("weekly_relative_risk", with_views(_PCT_SQL.format(exp="coalesce(sum(exposure), 0.0)"), "risk_panel"))
def weekly_relative_risk(spark, d):
    """R2: 100 x weekly accidents / weekly summed exposure."""
    w = _weekly(spark, d, scale=100.0, name="risk_pct")
    return round_doubles(w.select("grid", "year", "week", "accident", "exposure", "risk_pct"))


@query("weekly_relative_risk_mean7", with_views(_PCT_SQL.format(exp="(avg(exposure) * 7.0)"), "risk_panel"))
def weekly_relative_risk_mean7(spark, d):
    """R3 (A3): exposure as 7 x the mean daily exposure of the week."""
    w = _weekly(spark, d, scale=100.0, mode="mean7", name="risk_pct")
    return round_doubles(w.select("grid", "year", "week", "accident", "exposure", "risk_pct"))


@query("week_keys", with_views("""
SELECT grid, date, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
       CAST(isoyear(date) AS INTEGER) AS iso_year
FROM risk_panel""", "risk_panel"))
def week_keys(spark, d):
    """ISO week with the calendar-year key (reference) and the ISO-year key."""
    p = B.risk_panel(spark, d).select("grid", "date")
    return p.withColumns({"year": cal.week_year("date"), "week": cal.iso_week("date"),
                          "iso_year": cal.week_year("date", iso_year=True)})


# ------------------------------------------------------------ calendar & cleaning ---

@query("calendar_features", with_views("""
SELECT site, date, daily_count,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
       CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS weekend,
       ['winter', 'spring', 'summer', 'fall'][CAST(floor((month(date) % 12) / 3) AS INTEGER) + 1] AS season,
       CAST((month(date) = 1 AND day(date) = 1) OR (month(date) = 12 AND day(date) IN (25, 26)) AS INTEGER) AS is_holiday,
       CAST(week(date) AS INTEGER) AS week, CAST(year(date) AS INTEGER) AS year,
       CAST(CASE WHEN month(date) IN (9, 10, 11) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS season_fall,
       CAST(CASE WHEN month(date) IN (3, 4, 5) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS season_spring,
       CAST(CASE WHEN month(date) IN (6, 7, 8) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS season_summer,
       CAST(CASE WHEN month(date) IN (12, 1, 2) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS season_winter
FROM count_panel""", "count_panel"))
def calendar_features(spark, d):
    """Weekday, day, month, weekend, season (+ all four dummies),
    holiday flag (recurring 1 Jan / 25-26 Dec), ISO week and year."""
    p = B.count_panel(spark, d).select("site", "date", "daily_count")
    p = features.calendar_parts(p, "date", holidays=(), recurring=cal.RECURRING_HOLIDAYS)
    return features.season_dummies(p)


_PRIO = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUS = ["O", "P"]


@query("one_hot_levels", with_views(
    "SELECT o_orderkey, o_totalprice, "
    + ", ".join(f"CAST(coalesce(o_orderpriority = '{v}', false) AS INTEGER) AS \"o_orderpriority_{v}\"" for v in _PRIO)
    + ", "
    + ", ".join(f"CAST(coalesce(o_orderstatus = '{v}', false) AS INTEGER) AS \"o_orderstatus_{v}\"" for v in _STATUS)
    + " FROM order_levels", "order_levels"))
def one_hot_levels(spark, d):
    """One-hot of two categoricals, first level (sort order) dropped; the
    level lists are computed from the data."""
    o = B.order_levels(spark, d)
    return clean.one_hot(o, ["o_orderpriority", "o_orderstatus"], drop_first=True)


@query("parse_dirty", with_views("""
SELECT p_partkey, TRY_CAST(trim(replace(p_brand, 'Brand#', '')) AS DOUBLE) AS p_brand,
       TRY_CAST(p_size_text AS DOUBLE) AS p_size_text, NULLIF(p_kind, 'none') AS p_kind,
       NULLIF(p_type, 'none') AS p_type
FROM dirty_parts""", "dirty_parts"))
def parse_dirty(spark, d):
    """Unit-stripped number, bulk numeric coercion, sentinel -> NULL."""
    p = B.dirty_parts(spark, d).select("p_partkey", "p_brand", "p_size_text", "p_kind", "p_type")
    p = clean.strip_units(p, ["p_brand"], "Brand#")
    p = clean.to_numeric(p, ["p_size_text"])
    return clean.sentinel_to_null(p)


@query("fill_zero", with_views("""
SELECT site, date, daily_count, coalesce(price, 0.0) AS price FROM gappy_panel""", "gappy_panel"))
def fill_zero_q(spark, d):
    """Every NULL becomes 0."""
    return clean.fill_zero(B.gappy_panel(spark, d))


_INTERP_CTES = {
    "pos": """SELECT site, date, daily_count, price,
                     row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS p FROM gappy_panel""",
    "nb": """SELECT *, last_value(CASE WHEN price IS NOT NULL THEN p END IGNORE NULLS)
                     OVER (PARTITION BY site ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
                   first_value(CASE WHEN price IS NOT NULL THEN p END IGNORE NULLS)
                     OVER (PARTITION BY site ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
            FROM pos""",
    "vals": """SELECT nb.*, a.price AS pv, b.price AS nv FROM nb
              LEFT JOIN pos a ON a.site = nb.site AND a.p = nb.pp
              LEFT JOIN pos b ON b.site = nb.site AND b.p = nb.np""",
}


@query("interpolate_gaps", with_views("""
SELECT site, date, daily_count,
       round(CASE WHEN price IS NOT NULL THEN price
                  WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp)
                  WHEN pp IS NOT NULL THEN pv ELSE nv END, 6) AS price
FROM vals""", "gappy_panel", extra=_INTERP_CTES))
def interpolate_gaps(spark, d):
    """Linear interpolation of price gaps by position within each site's date order."""
    g = B.gappy_panel(spark, d)
    return round_doubles(clean.interpolate(g, ["price"], ["date"], ["site"]))


#: A site of the count panel whose key the null-key queries replace by NULL.
_NULL_SITE = 7


def _with_null_site(p):
    return p.withColumn("site", F.when(F.col("site") != _NULL_SITE, F.col("site")))


_NULL_SITE_SQL = f"CASE WHEN site <> {_NULL_SITE} THEN site END"


@query("interpolate_null_site", with_views(f"""
SELECT {_NULL_SITE_SQL} AS site, date, daily_count,
       round(CASE WHEN price IS NOT NULL THEN price
                  WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp)
                  WHEN pp IS NOT NULL THEN pv ELSE nv END, 6) AS price
FROM vals""", "gappy_panel", extra=_INTERP_CTES))
def interpolate_null_site(spark, d):
    """W4 where one site's key is NULL: its rows are a partition like any other."""
    g = _with_null_site(B.gappy_panel(spark, d))
    return round_doubles(clean.interpolate(g, ["price"], ["date"], ["site"]))


@query("logo_linear_one", with_views("""
SELECT p.site, p.date, round(((t.sy - g.sy) - s.slope * (t.sx - g.sx)) / (t.n - g.n) + s.slope * month(p.date), 6) AS predicted
FROM count_panel p JOIN sums g USING (site) CROSS JOIN total t
JOIN (SELECT g.site, ((t.n - g.n) * (t.sxy - g.sxy) - (t.sx - g.sx) * (t.sy - g.sy))
                     / ((t.n - g.n) * (t.sxx - g.sxx) - (t.sx - g.sx) * (t.sx - g.sx)) AS slope
      FROM sums g CROSS JOIN total t) s USING (site)""", "count_panel", extra={
    "sums": """SELECT site, count(*)::DOUBLE AS n, sum(month(date))::DOUBLE AS sx, sum(daily_count)::DOUBLE AS sy,
               sum(month(date) * month(date))::DOUBLE AS sxx, sum(month(date) * daily_count)::DOUBLE AS sxy
               FROM count_panel GROUP BY site""",
    "total": "SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM sums"}))
def logo_linear_one(spark, d):
    """L1 + M5 + M6 with one predictor: for every site, the line fitted to all other sites."""
    from ..operators import learn
    p = B.count_panel(spark, d).select("site", "date", "daily_count", F.month("date").alias("month"))
    return round_doubles(learn.logo_linear(p, ["month"], "daily_count", "site", prediction="predicted").select("site", "date", "predicted"))


@query("population_scale", with_views("""
SELECT site, date, round((coalesce(price, m) - m) / s, 6) AS price, round((daily_count - cm) / cs, 6) AS daily_count
FROM gappy_panel, (SELECT any_value(m) AS m, stddev_pop(coalesce(price, m)) AS s, avg(daily_count) AS cm, stddev_pop(daily_count) AS cs
                   FROM gappy_panel, (SELECT avg(price) AS m FROM gappy_panel WHERE year(date) <= 1998) WHERE year(date) <= 1998)
WHERE year(date) > 1998""", "gappy_panel"))
def population_scale_q(spark, d):
    """M2, exact: train means fill the gaps, columns centred and divided by the population deviation."""
    from ..operators import learn
    g = B.gappy_panel(spark, d)
    _, te = learn.population_scale(g.where(F.year("date") <= 1998), g.where(F.year("date") > 1998), ["price", "daily_count"])
    return round_doubles(te.select("site", "date", "price", "daily_count"))


_FAR = 1e9


@query("out_of_fold_scale", with_views(f"""
SELECT f.fold, round(avg(x) - {_FAR}, 4) AS mean_off, round(stddev_pop(x), 6) AS scale
FROM (SELECT DISTINCT fold FROM rows_) f JOIN rows_ r ON r.fold <> f.fold GROUP BY f.fold""", "count_panel", extra={
    "rows_": f"SELECT CAST(site % 5 AS INTEGER) AS fold, {_FAR} + daily_count + site AS x FROM count_panel"}))
def out_of_fold_scale(spark, d):
    """W3 for cross-validation: mean (less 1e9) and deviation outside each fold, of values near 1e9, where a double
    resolves 1e-7: the mean is reported to four decimals."""
    p = B.count_panel(spark, d).select((F.col("site") % 5).cast("int").alias("fold"), (F.lit(_FAR) + F.col("daily_count") + F.col("site")).alias("x"))
    out = scaling.fit_out_of_fold(p, "fold", "x")
    return round_doubles(out.select("fold", F.round(F.col("mean") - _FAR, 4).alias("mean_off"), "scale"))


@query("logo_folds_null", with_views(f"""
SELECT {_NULL_SITE_SQL} AS site, date,
       CAST(dense_rank() OVER (ORDER BY {_NULL_SITE_SQL} NULLS FIRST) - 1 AS INTEGER) AS fold FROM count_panel""", "count_panel"))
def logo_folds_null(spark, d):
    """M5 with a NULL group, which is a fold of its own."""
    return split.logo_folds(_with_null_site(B.count_panel(spark, d)).select("site", "date"), "site")


@query("group_kfold", with_views("""
SELECT site, date, CAST((dense_rank() OVER (ORDER BY site) - 1) % 5 AS INTEGER) AS fold FROM count_panel""", "count_panel"))
def group_kfold_q(spark, d):
    """M5 for many groups: sites dealt into 5 folds by rank."""
    return split.group_kfold(B.count_panel(spark, d).select("site", "date"), "site", 5)


@query("kfold_stratified_null", with_views("""
SELECT site, date, label, CAST(fold AS INTEGER) AS fold FROM (
  SELECT r.*, f.fold, row_number() OVER (PARTITION BY r.site, r.date ORDER BY f.fold) AS k
  FROM (SELECT site, date, label, row_number() OVER (PARTITION BY label ORDER BY site, date) - 1 AS pos
        FROM (SELECT site, date, CASE WHEN site % 4 > 0 THEN site % 4 END AS label FROM count_panel)) r
  JOIN (SELECT label, f AS fold, sum(size) OVER (PARTITION BY label ORDER BY f) AS upto
        FROM (SELECT label, f, count(*) FILTER (i % 3 = f) AS size
              FROM (SELECT label, row_number() OVER (ORDER BY label NULLS FIRST) - 1 AS i
                    FROM (SELECT CASE WHEN site % 4 > 0 THEN site % 4 END AS label FROM count_panel))
              CROSS JOIN (SELECT unnest(range(3)) AS f) GROUP BY label, f)) f
  ON f.label IS NOT DISTINCT FROM r.label AND r.pos < f.upto) WHERE k = 1""", "count_panel"))
def kfold_stratified_null(spark, d):
    """W5 with a label that is NULL for some rows: a class of its own."""
    label = F.when(F.col("site") % 4 > 0, F.col("site") % 4)
    p = B.count_panel(spark, d).select("site", "date", label.alias("label"))
    return split.fold_id(p, 3, ["site", "date"], label="label")


# ------------------------------------------------------------- shared SQL ---

# The weekly panel of `_weekly` without rounding (used inside larger oracles).
_WEEKLY_RAW = f"""
SELECT grid, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
       avg(f_discount) AS f_discount, avg(f_tax) AS f_tax, avg(f_price) AS f_price,
       CAST(coalesce(sum(accident), 0) AS BIGINT) AS accident,
       coalesce(sum(exposure), 0.0) AS exposure,
       coalesce(1000.0 * coalesce(sum(accident), 0) / nullif(coalesce(sum(exposure), 0.0), 0), 0.0) AS risk,
       CAST(coalesce(sum(accident), 0) > 0 AS INTEGER) AS occurrence
FROM risk_panel
WHERE grid IS NOT NULL AND date IS NOT NULL AND (grid NOT IN ({EXCL}) OR grid IS NULL)
GROUP BY 1, 2, 3"""

TRAIN, TEST = (1, 26), (27, 52)   # the reference's second temporal split

_PRED_CTES = {
    "weekly": _WEEKLY_RAW,
    "cellm": f"SELECT grid, avg(risk) AS m, avg(occurrence) AS mo FROM weekly WHERE week BETWEEN {TRAIN[0]} AND {TRAIN[1]} GROUP BY grid",
    "gmean": f"SELECT avg(risk) AS gm, avg(occurrence) AS gmo FROM weekly WHERE week BETWEEN {TRAIN[0]} AND {TRAIN[1]}",
    "pred": f"""SELECT w.grid, w.year, w.week, w.risk, w.occurrence,
                       coalesce(c.m, gmean.gm) AS predicted, coalesce(c.mo, gmean.gmo) AS predicted_rate,
                       gmean.gm AS predicted_global
                FROM weekly w LEFT JOIN cellm c ON w.grid = c.grid CROSS JOIN gmean
                WHERE w.week BETWEEN {TEST[0]} AND {TEST[1]}""",
}


def _rnd(expr: str) -> str:
    return f"round({expr}, 6)"


def _reg_sql(y: str, p: str, cond: str | None = None, suffix: str = "") -> str:
    def w(e):
        return e if cond is None else f"CASE WHEN {cond} THEN {e} END"
    e = f"({p} - {y})"
    n = f"count({w(e)})"
    sse = f"sum({w(f'{e} * {e}')})"
    sst = f"(var_pop({w(y)}) * {n})"
    r2 = f"CASE WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - {sse} / {sst} END"
    return ", ".join([
        f"CAST({n} AS BIGINT) AS n{suffix}",
        f"{_rnd(f'avg({w(f'abs({e})')})')} AS mae{suffix}",
        f"{_rnd(f'sqrt(avg({w(f'{e} * {e}')}))')} AS rmse{suffix}",
        f"{_rnd(f'CAST({r2} AS DOUBLE)')} AS r2{suffix}",
        f"{_rnd(f'100.0 * avg({w(f'2.0 * abs({e}) / (abs({y}) + abs({p}) + 1e-10)')})')} AS smape{suffix}",
    ])


def _pred(spark, d, target="risk"):
    w = _weekly(spark, d)
    return evaluate.baseline_predict(w, cell="grid", target=target, train=TRAIN, test=TEST)


def _pred_both(spark, d):
    """Test rows with the risk prediction and the occurrence-rate prediction."""
    w = _weekly(spark, d)
    p = evaluate.baseline_predict(w, cell="grid", target="risk", train=TRAIN, test=TEST)
    r = evaluate.baseline_predict(w.select("grid", "year", "week", "occurrence"), cell="grid",
                                  target="occurrence", train=TRAIN, test=TEST, out="predicted_rate")
    return p.join(r.select("grid", "year", "week", "predicted_rate"), ["grid", "year", "week"])


# ------------------------------------------------------------ profile / drop ---

_PARTS_COLS = [("p_partkey", "bigint", True), ("p_brand", "string", False), ("p_type", "string", False),
               ("p_size", "int", True), ("p_retailprice", "double", True), ("p_kind", "string", False),
               ("p_size_text", "string", False)]


@query("column_profile", with_views(" UNION ALL ".join(
    f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, '{c}' AS column_name, '{t}' AS dtype, {str(num).lower()} AS is_numeric,
               false AS duplicated, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null,
               CAST(count_if(coalesce(contains(CAST({c} AS VARCHAR), 'none'), false)) AS BIGINT) AS n_sentinel,
               count_if({c} IS NULL) = count(*) AS all_null FROM dirty_parts"""
    for c, t, num in _PARTS_COLS), "dirty_parts"))
def column_profile(spark, d):
    """One-pass column audit (NULLs, sentinel hits, type, duplicates)."""
    return clean.profile_columns(B.dirty_parts(spark, d))


@query("drop_all_null", with_views("""
SELECT p_partkey, p_size, p_retailprice, TRY_CAST(p_size_text AS DOUBLE) AS p_size_text FROM dirty_parts""",
                                   "dirty_parts"))
def drop_all_null_q(spark, d):
    """P10 + P22: coerce every text column to a number, then drop the columns
    left without any value (found by one aggregate pass over the data)."""
    p = B.dirty_parts(spark, d)
    p = clean.to_numeric(p, ["p_brand", "p_type", "p_kind", "p_size_text"])
    return clean.drop_all_null(p)


# ------------------------------------------------------------------ filters ---

@query("filter_status", with_views("SELECT * FROM order_levels WHERE o_orderstatus = 'F'", "order_levels"))
def filter_status(spark, d):
    """equality filter."""
    return panel.eq_filter(B.order_levels(spark, d), "o_orderstatus", "F")


@query("exclude_levels", with_views("""
SELECT * FROM order_levels WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderpriority IS NULL""",
                                    "order_levels"))
def exclude_levels(spark, d):
    """exclusion list, NULL keys kept."""
    return panel.exclude(B.order_levels(spark, d), "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("distinct_levels", with_views("""
SELECT DISTINCT o_orderpriority, o_orderstatus FROM order_levels""", "order_levels"))
def distinct_levels(spark, d):
    """Distinct level pairs (sorted)."""
    return panel.distinct_on(B.order_levels(spark, d), ["o_orderpriority", "o_orderstatus"]) \
        .orderBy("o_orderpriority", "o_orderstatus")


@query("distinct_count", "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_distinct FROM orders")
def distinct_count(spark, d):
    """Exact distinct count."""
    from ..sources.io import read_table
    return panel.distinct_values(read_table(spark, d, "orders"), "o_custkey")


@query("week_range", with_views(
    "SELECT grid, year, week, round(risk, 6) AS risk FROM weekly WHERE week BETWEEN 10 AND 20",
    "risk_panel", extra={"weekly": _WEEKLY_RAW}))
def week_range(spark, d):
    """inclusive week range of the weekly panel."""
    w = panel.week_between(_weekly(spark, d), 10, 20)
    return round_doubles(w.select("grid", "year", "week", "risk"))


@query("stations", with_views("""
SELECT DISTINCT segment, station_id, lon, lat FROM points
WHERE coalesce(contains(segment, 'O'), false) AND lon IS NOT NULL AND lat IS NOT NULL
  AND (segment NOT IN ('HOUSEHOLD') OR segment IS NULL)""", "points"))
def stations_q(spark, d):
    """G3 (F2 + F5 + F3 + F6): station catalogue."""
    return geo_ops.stations(B.points(spark, d), site="segment", lon="lon", lat="lat",
                            valid_substring="O", exclude=["HOUSEHOLD"], keep=["station_id"])


@query("station_mercator", with_views("""
SELECT station_id, lon, lat, round(6378137.0 * radians(lon), 6) AS x,
       round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 6) AS y FROM points""", "points"))
def station_mercator(spark, d):
    """G1: WGS84 -> Web Mercator."""
    p = B.points(spark, d).select("station_id", "lon", "lat")
    return round_doubles(geo_ops.to_mercator(p))


@query("scan_panel", """
SELECT l_suppkey, l_shipdate, l_quantity, l_discount FROM lineitem WHERE l_linestatus = 'O'""")
def scan_panel(spark, d):
    """Parquet scan with an explicit column list and a pushed filter; NaN -> NULL."""
    from ..sources.io import read_panel
    li = read_panel(spark, f"{d}/lineitem.parquet")
    return li.where(F.col("l_linestatus") == "O").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")


# -------------------------------------------------------------------- joins ---

@query("attach_exposure", with_views(f"""
SELECT a.grid, a.year, a.week, a.accident, round(coalesce(e.exposure, 0.0), 6) AS exposure
FROM (SELECT grid, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
             CAST(coalesce(sum(accident), 0) AS BIGINT) AS accident
      FROM risk_panel GROUP BY 1, 2, 3) a
LEFT JOIN (SELECT grid, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
                  coalesce(sum(exposure), 0.0) AS exposure
           FROM risk_panel WHERE exposure > 0 GROUP BY 1, 2, 3) e
  ON a.grid = e.grid AND a.year = e.year AND a.week = e.week""", "risk_panel"))
def attach_exposure(spark, d):
    """Weekly accidents left-joined with a separately aggregated exposure
    table on (grid, year, week); weeks without exposure rows get 0."""
    p = panel.with_week_key(B.risk_panel(spark, d), "date")
    keys = ["grid", "year", "week"]
    acc = panel.weekly_rollup(p, keys, sums=["accident"])
    exp = panel.weekly_rollup(p.where(F.col("exposure") > 0), keys, exposure="exposure", exposure_name="exposure")
    return round_doubles(joins.attach(acc, exp, keys, "left", fill=0.0))


_SURFACE_CTES = {
    "acc": """SELECT grid, CAST(sum(accident) AS BIGINT) AS accidents
              FROM (SELECT DISTINCT grid, date, accident FROM risk_panel) GROUP BY grid""",
    "vol": "SELECT grid, sum(exposure) AS total_exposure, avg(exposure) AS mean_exposure FROM risk_panel GROUP BY grid",
    "dr": """SELECT grid, avg(coalesce(100.0 * accident / nullif(exposure, 0), 0.0)) AS mean_daily_risk
             FROM risk_panel GROUP BY grid""",
    "wk": """SELECT grid, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week,
                    coalesce(100.0 * coalesce(sum(accident), 0) / nullif(coalesce(sum(exposure), 0.0), 0), 0.0) AS r
             FROM risk_panel WHERE grid IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2, 3""",
    "wr": "SELECT grid, avg(r) AS mean_weekly_risk FROM wk GROUP BY grid",
    "surface": """SELECT acc.grid, accidents, total_exposure, mean_exposure,
                         accidents / nullif(total_exposure, 0) AS annual_risk,
                         mean_daily_risk, mean_weekly_risk, total_exposure / 1e6 AS exposure_millions,
                         ln(1 + total_exposure) AS log_exposure, ln(1 + accidents) AS log_accidents
                  FROM acc JOIN vol ON acc.grid = vol.grid JOIN dr ON acc.grid = dr.grid
                  JOIN wr ON acc.grid = wr.grid""",
}
_SURFACE_DBL = ["total_exposure", "mean_exposure", "annual_risk", "mean_daily_risk", "mean_weekly_risk",
                "exposure_millions", "log_exposure", "log_accidents"]


def _surface(spark, d):
    return risk.risk_surface(B.risk_panel(spark, d))


@query("risk_surface", with_views(
    "SELECT grid, accidents, " + ", ".join(f"{_rnd(c)} AS {c}" for c in _SURFACE_DBL) + " FROM surface",
    "risk_panel", extra=_SURFACE_CTES))
def risk_surface_q(spark, d):
    """R7 (R4-R6, A4-A6, J2, P14, P15): per-cell risk surface."""
    return round_doubles(_surface(spark, d))


@query("annual_risk", with_views(f"""
SELECT acc.grid, accidents, {_rnd('total_exposure')} AS total_exposure, {_rnd('mean_exposure')} AS mean_exposure,
       {_rnd('accidents / nullif(total_exposure, 0)')} AS annual_risk
FROM acc JOIN vol ON acc.grid = vol.grid""", "risk_panel", extra=_SURFACE_CTES))
def annual_risk_q(spark, d):
    """R4 (A4 + A5 + J2): deduplicated accidents over total exposure per cell."""
    return round_doubles(risk.annual_risk(B.risk_panel(spark, d)))


@query("mean_daily_risk", with_views(f"SELECT grid, {_rnd('mean_daily_risk')} AS mean_daily_risk FROM dr",
                                     "risk_panel", extra=_SURFACE_CTES))
def mean_daily_risk(spark, d):
    """R5 (P13 + A6): mean over days of the safe daily ratio."""
    return round_doubles(risk.mean_risk(B.risk_panel(spark, d), level="day"))


@query("mean_weekly_risk", with_views(f"SELECT grid, {_rnd('mean_weekly_risk')} AS mean_weekly_risk FROM wr",
                                      "risk_panel", extra=_SURFACE_CTES))
def mean_weekly_risk(spark, d):
    """Mean over weeks of the weekly relative risk."""
    return round_doubles(risk.mean_risk(B.risk_panel(spark, d), level="week"))


@query("mean_weekly_risk_compat", with_views(f"SELECT grid, {_rnd('mean_daily_risk')} AS mean_weekly_risk FROM dr",
                                             "risk_panel", extra=_SURFACE_CTES))
def mean_weekly_risk_compat(spark, d):
    """R6 in the reference's form: its 'weekly' ratio is the daily row-level
    ratio, so the mean equals R5."""
    return round_doubles(risk.mean_risk(B.risk_panel(spark, d), level="week", reference_compat=True))


@query("deduped_accidents", with_views("SELECT grid, accidents FROM acc", "risk_panel", extra=_SURFACE_CTES))
def deduped_accidents(spark, d):
    """A5: accidents over distinct (cell, date, accident) rows."""
    return panel.deduped_total(B.risk_panel(spark, d), "grid", "date", "accident", name="accidents")


@query("cell_totals", with_views(
    f"SELECT grid, {_rnd('total_exposure')} AS total, {_rnd('mean_exposure')} AS mean FROM vol",
    "risk_panel", extra=_SURFACE_CTES))
def cell_totals_q(spark, d):
    """A4: per-cell sum and mean of exposure."""
    return round_doubles(panel.cell_totals(B.risk_panel(spark, d), "grid", "exposure"))


@query("cell_feature_means", with_views(f"""
SELECT acc.grid, accidents, {_rnd('total_exposure')} AS total_exposure,
       {_rnd('m.f_discount')} AS f_discount, {_rnd('m.f_tax')} AS f_tax, {_rnd('m.f_price')} AS f_price
FROM acc JOIN vol ON acc.grid = vol.grid
LEFT JOIN (SELECT grid, {exact_mean('f_discount')} AS f_discount, {exact_mean('f_tax')} AS f_tax, {exact_mean('f_price')} AS f_price
           FROM risk_panel GROUP BY grid) m ON acc.grid = m.grid""", "risk_panel", extra=_SURFACE_CTES))
def cell_feature_means(spark, d):
    """J4 + A7: per-cell feature means left-joined onto the per-cell totals."""
    p = B.risk_panel(spark, d)
    base = risk.annual_risk(p).select("grid", "accidents", "total_exposure")
    means = panel.cell_mean(p, "grid", list(B.PANEL_FEATURES))
    return round_doubles(joins.attach(base, means, "grid", "left"))


@query("reorder_sites", with_views("""
SELECT site, CAST(sum(daily_count) AS BIGINT) AS total, CAST(20 - site AS INTEGER) AS position
FROM count_panel WHERE site < 20 GROUP BY site""", "count_panel"))
def reorder_sites(spark, d):
    """Per-site totals in a given key order (nation keys 19..0), with the position in it; sites
    that aren't listed are dropped."""
    p = B.count_panel(spark, d)
    totals = p.groupBy("site").agg(F.sum("daily_count").alias("total"))
    return joins.reorder(totals, "site", list(range(19, -1, -1)))


@query("write_back", with_views(f"""
SELECT w.grid, w.year, w.week, {_rnd('w.risk')} AS risk, {_rnd('p.predicted')} AS predicted
FROM weekly w LEFT JOIN pred p ON w.grid = p.grid AND w.year = p.year AND w.week = p.week""",
                                "risk_panel", extra=_PRED_CTES))
def write_back_q(spark, d):
    """Test-week predictions written back onto the whole weekly panel;
    training rows keep a NULL prediction."""
    w = _weekly(spark, d).select("grid", "year", "week", "risk")
    p = _pred(spark, d)
    return round_doubles(joins.write_back(w, p, ["grid", "year", "week"], "predicted"))


# --------------------------------------------------------------- evaluation ---

@query("baseline_metrics", with_views(f"SELECT {_reg_sql('risk', 'predicted')} FROM pred",
                                      "risk_panel", extra=_PRED_CTES))
def baseline_metrics(spark, d):
    """E1 + E2: MAE, RMSE, R^2 and SMAPE of the baseline risk prediction."""
    return round_doubles(evaluate.regression_metrics(_pred(spark, d), "risk", "predicted"))


@query("nonzero_metrics", with_views(
    f"SELECT {_reg_sql('risk', 'predicted')}, {_reg_sql('risk', 'predicted', 'risk <> 0', '_nonzero')} FROM pred",
    "risk_panel", extra=_PRED_CTES))
def nonzero_metrics_q(spark, d):
    """The metric set overall and on non-zero truth, one pass."""
    return round_doubles(evaluate.nonzero_metrics(_pred(spark, d), "risk", "predicted"))


@query("smape_by_zero", with_views(f"""
SELECT {_rnd('100.0 * avg(2.0 * abs(predicted - risk) / (abs(risk) + abs(predicted) + 1e-10))')} AS smape_all,
       {_rnd('100.0 * avg(CASE WHEN risk = 0 THEN 2.0 * abs(predicted - risk) / (abs(risk) + abs(predicted) + 1e-10) END)')} AS smape_zero,
       {_rnd('100.0 * avg(CASE WHEN risk <> 0 THEN 2.0 * abs(predicted - risk) / (abs(risk) + abs(predicted) + 1e-10) END)')} AS smape_nonzero
FROM pred""", "risk_panel", extra=_PRED_CTES))
def smape_by_zero_q(spark, d):
    """E5: SMAPE split by zero / non-zero truth."""
    return round_doubles(evaluate.smape_by_zero(_pred(spark, d), "risk", "predicted"))


_CLS = "CAST(predicted_rate > 0.5 AS INTEGER)"


@query("class_metrics", with_views(f"""
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       {_rnd('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision,
       {_rnd('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall,
       {_rnd('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1
FROM (SELECT count_if(occurrence = 1 AND {_CLS} = 1) AS tp, count_if(occurrence = 0 AND {_CLS} = 1) AS fp,
             count_if(occurrence = 1 AND {_CLS} = 0) AS fn, count_if(occurrence = 0 AND {_CLS} = 0) AS tn
      FROM pred)""", "risk_panel", extra=_PRED_CTES))
def class_metrics_q(spark, d):
    """E3 + P20: precision/recall/F1 of the thresholded (0.5) occurrence rate."""
    p = _pred_both(spark, d).withColumn("predicted_label", fx.binarize("predicted_rate", 0.5))
    return round_doubles(evaluate.class_metrics(p, "occurrence", "predicted_label"))


@query("confusion", with_views(f"""
SELECT l.label, l.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(label, prediction)) l
LEFT JOIN (SELECT occurrence AS label, {_CLS} AS prediction, count(*) AS n FROM pred GROUP BY 1, 2) c
  ON l.label = c.label AND l.prediction = c.prediction""", "risk_panel", extra=_PRED_CTES))
def confusion_q(spark, d):
    """2x2 confusion matrix with empty cells as 0."""
    p = _pred_both(spark, d).withColumn("predicted_label", fx.binarize("predicted_rate", 0.5))
    return stats.confusion(p, "occurrence", "predicted_label")


_PER_CELL = f"SELECT grid, {_reg_sql('risk', 'predicted')} FROM pred GROUP BY grid"


@query("per_cell_metrics", with_views(_PER_CELL, "risk_panel", extra=_PRED_CTES))
def per_cell_metrics(spark, d):
    """Metrics per cell."""
    return round_doubles(evaluate.regression_metrics(_pred(spark, d), "risk", "predicted", by=["grid"]))


@query("pooled_vs_mean", with_views(f"""
SELECT {_rnd('pooled_smape')} AS pooled_smape, {_rnd('pooled_mae')} AS pooled_mae,
       {_rnd('mean_group_smape')} AS mean_group_smape, {_rnd('mean_group_mae')} AS mean_group_mae, n_groups
FROM (SELECT 100.0 * avg(2.0 * abs(predicted - risk) / (abs(risk) + abs(predicted) + 1e-10)) AS pooled_smape,
             avg(abs(predicted - risk)) AS pooled_mae FROM pred) a,
     (SELECT avg(s) AS mean_group_smape, avg(m) AS mean_group_mae, CAST(count(*) AS BIGINT) AS n_groups
      FROM (SELECT grid, 100.0 * avg(2.0 * abs(predicted - risk) / (abs(risk) + abs(predicted) + 1e-10)) AS s,
                   avg(abs(predicted - risk)) AS m FROM pred GROUP BY grid)) b""", "risk_panel", extra=_PRED_CTES))
def pooled_vs_mean(spark, d):
    """Pooled SMAPE/MAE next to the mean of per-cell values."""
    return round_doubles(evaluate.pooled_and_mean(_pred(spark, d), "risk", "predicted", "grid"))


@query("leaderboard", with_views(f"""
SELECT model, {_reg_sql('risk', 'p')} FROM (
  SELECT 'cell_mean' AS model, risk, predicted AS p FROM pred
  UNION ALL SELECT 'global_mean' AS model, risk, predicted_global AS p FROM pred) GROUP BY model""",
                                 "risk_panel", extra=_PRED_CTES))
def leaderboard_q(spark, d):
    """E8 + C1: two predictors' test rows unioned with a model column, one
    metric row per model, sorted by SMAPE."""
    w = _weekly(spark, d)
    p = evaluate.baseline_predict(w, cell="grid", target="risk", train=TRAIN, test=TEST, global_out="predicted_global")
    a = p.select(F.lit("cell_mean").alias("model"), "risk", F.col("predicted").alias("p"))
    b = p.select(F.lit("global_mean").alias("model"), "risk", F.col("predicted_global").alias("p"))
    return round_doubles(evaluate.leaderboard(evaluate.union_folds(a, b), "model", "risk", "p"))


@query("top_cells", with_views(_PER_CELL.replace("SELECT grid,", "SELECT * FROM (SELECT grid,", 1)
                               + ") ORDER BY smape DESC, grid LIMIT 10", "risk_panel", extra=_PRED_CTES))
def top_cells(spark, d):
    """T1 + T2: the 10 cells with the highest SMAPE (ties by cell id)."""
    m = evaluate.regression_metrics(_pred(spark, d), "risk", "predicted", by=["grid"])
    return round_doubles(evaluate.top_k(m, "smape", 10, tie="grid"))


@query("below_threshold", with_views(f"SELECT * FROM ({_PER_CELL}) WHERE smape < 196", "risk_panel",
                                     extra=_PRED_CTES))
def below_threshold(spark, d):
    """keep cells whose SMAPE is under a threshold."""
    m = evaluate.regression_metrics(_pred(spark, d), "risk", "predicted", by=["grid"])
    return round_doubles(panel.below(m, "smape", 196.0))


@query("threshold_metrics", with_views(f"""
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, m.*
FROM (SELECT count(*) FILTER (risk > 1 AND predicted > 1) AS tp, count(*) FILTER (risk <= 1 AND predicted > 1) AS fp,
             count(*) FILTER (risk > 1 AND predicted <= 1) AS fn FROM pred) c,
     (SELECT {_reg_sql('risk', 'predicted')}, {_reg_sql('risk', 'predicted', 'risk > 0', '_nonzero')} FROM pred) m""",
                                         "risk_panel", extra=_PRED_CTES))
def threshold_metrics_q(spark, d):
    """P20 + E1-E4 in one table: truth and prediction binarised above 1, with the regression metrics."""
    return round_doubles(evaluate.threshold_metrics(_pred(spark, d), "risk", "predicted", threshold=1.0))


@query("residuals", with_views(f"""
SELECT grid, year, week, {_rnd('risk - predicted')} AS residual, {_rnd('predicted - risk')} AS residual_pred,
       {_rnd('abs(predicted - risk)')} AS abs_error FROM pred""", "risk_panel", extra=_PRED_CTES))
def residuals(spark, d):
    """Both residual conventions and the absolute error."""
    p = _pred(spark, d)
    return round_doubles(p.select("grid", "year", "week",
                                  fx.residual("risk", "predicted").alias("residual"),
                                  fx.residual("risk", "predicted", "pred_minus_true").alias("residual_pred"),
                                  fx.residual("risk", "predicted", "abs").alias("abs_error")))


@query("metrics_long", with_views(f"""
SELECT metric, round(value, 6) AS value FROM (
  SELECT {_reg_sql('risk', 'predicted')} FROM pred)
UNPIVOT (value FOR metric IN (n, mae, rmse, r2, smape))""".replace("CAST(count(", "CAST(count(", 1),
                                  "risk_panel", extra=_PRED_CTES))
def metrics_long_q(spark, d):
    """K2: scalar metrics as (metric, value) rows."""
    from ..sources.io import metrics_long
    m = evaluate.regression_metrics(_pred(spark, d), "risk", "predicted")
    return round_doubles(metrics_long(round_doubles(m)))


_LAYER_SQL = """(
  SELECT w.grid, w.year, w.week, w.risk, p.predicted, min(least(w.risk, p.predicted)) OVER () AS vmin,
         max(greatest(w.risk, p.predicted)) OVER () AS vmax
  FROM weekly w LEFT JOIN pred p ON w.grid = p.grid AND w.year = p.year AND w.week = p.week)"""


def _written_back(spark, d):
    w = _weekly(spark, d).select("grid", "year", "week", F.col("risk").alias("actual"))
    return joins.write_back(w, _pred(spark, d), ["grid", "year", "week"], "predicted")


@query("map_layer", with_views(f"""
SELECT grid, year, week, {_rnd('risk')} AS actual, {_rnd('predicted')} AS predicted,
       {_rnd('vmin')} AS vmin, {_rnd('vmax')} AS vmax
FROM {_LAYER_SQL} WHERE week >= 40""", "risk_panel", extra=_PRED_CTES))
def map_layer_q(spark, d):
    """R8 (+F8, A9, J6): actual vs predicted per cell-week from week 40 on, with bounds over every week of the
    panel that the predictions are written back to."""
    return round_doubles(risk.map_layer(_written_back(spark, d), min_week=40))


@query("shared_bounds", with_views(f"""
SELECT {_rnd('min(least(risk, predicted))')} AS vmin, {_rnd('max(greatest(risk, predicted))')} AS vmax FROM pred""",
                                   "risk_panel", extra=_PRED_CTES))
def shared_bounds_q(spark, d):
    """One colour scale over actual and predicted."""
    return round_doubles(stats.shared_bounds(_pred(spark, d), "risk", "predicted"))


@query("global_mean", with_views(f"SELECT {_rnd('avg(smape)')} AS mean FROM ({_PER_CELL})", "risk_panel",
                                 extra=_PRED_CTES))
def global_mean_q(spark, d):
    """A10: the mean line over per-cell SMAPE."""
    m = evaluate.regression_metrics(_pred(spark, d), "risk", "predicted", by=["grid"])
    return round_doubles(panel.global_mean(m, "smape"))


# -------------------------------------------------------------------- stats ---

@query("risk_histogram", with_views(f"""
SELECT s.bin, {_rnd('lo + (s.bin - 1) * ((hi - lo) / 30)')} AS edge_lo, {_rnd('lo + s.bin * ((hi - lo) / 30)')} AS edge_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 31)) s CROSS JOIN b
LEFT JOIN (SELECT least(CAST(floor(30 * (risk - lo) / (hi - lo) + 1) AS INTEGER), 30) AS bin, count(*) AS n
           FROM weekly CROSS JOIN b WHERE risk IS NOT NULL GROUP BY 1) c ON s.bin = c.bin""",
    "risk_panel", extra={"weekly": _WEEKLY_RAW,
                         "b": """SELECT CASE WHEN min(risk) = max(risk) THEN min(risk) - 0.5 ELSE min(risk) END AS lo,
                                        CASE WHEN min(risk) = max(risk) THEN max(risk) + 0.5 ELSE max(risk) END AS hi
                                 FROM weekly WHERE risk IS NOT NULL"""}))
def risk_histogram(spark, d):
    """30 equal-width bins of the weekly risk, empty bins listed."""
    return round_doubles(stats.histogram(_weekly(spark, d), "risk", 30))


@query("box_stats", with_views("""
SELECT q.site, CAST(row_number() OVER (ORDER BY q.site) AS BIGINT) AS label, q.n,
       round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, n_outliers
FROM q JOIN w ON q.site = w.site""", "count_panel", extra={
    "x": "SELECT site, CAST(daily_count AS DOUBLE) AS x FROM count_panel WHERE daily_count IS NOT NULL",
    "q": """SELECT site, CAST(count(*) AS BIGINT) AS n, quantile_cont(x, 0.25) AS q1,
                   quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY site""",
    "w": """SELECT x.site, min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_low,
                   max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
                   CAST(count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
            FROM x JOIN q ON x.site = q.site GROUP BY x.site"""}))
def box_stats_q(spark, d):
    """Per-site box statistics of daily counts, exact quartiles, labels 1..n."""
    return round_doubles(stats.box_stats(B.count_panel(spark, d), "site", "daily_count"))


@query("pearson_surface", with_views(f"""
SELECT {_rnd('corr(total_exposure, accidents)')} AS r_total_exposure_accidents,
       {_rnd('corr(log_exposure, log_accidents)')} AS r_log_exposure_log_accidents FROM surface""",
    "risk_panel", extra=_SURFACE_CTES))
def pearson_surface(spark, d):
    """Raw and log-log Pearson correlation of exposure and accidents per cell."""
    return round_doubles(stats.pearson(_surface(spark, d), [("total_exposure", "accidents"),
                                                            ("log_exposure", "log_accidents")]))


@query("pearson_events", with_views(f"""
SELECT {_rnd('corr(n_events, value_sum)')} AS r_n_events_value_sum,
       {_rnd('corr(n_errors, value_sum)')} AS r_n_errors_value_sum FROM event_days""", "event_days"))
def pearson_events(spark, d):
    """A13 on the second source (user x day event counts)."""
    return round_doubles(stats.pearson(B.event_days(spark, d), [("n_events", "value_sum"), ("n_errors", "value_sum")]))


_OLS1 = """
SELECT CAST(n AS BIGINT) AS n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS r2_adj,
       round(intercept, 6) AS intercept, round(se_i, 6) AS se_intercept, round(intercept / se_i, 6) AS t_intercept,
       round(slope, 6) AS slope, round(se_s, 6) AS se_slope, round(slope / se_s, 6) AS t_slope
FROM (SELECT *, sqrt(s2 / sxx) AS se_s, sqrt(s2 * (1.0 / n + xbar * xbar / sxx)) AS se_i
      FROM (SELECT *, (syy - slope * sxy) / (n - 2) AS s2
            FROM (SELECT regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
                         regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy,
                         regr_syy({y}, {x}) AS syy, regr_avgx({y}, {x}) AS xbar FROM {src})))"""


@query("ols_loglog", with_views(_OLS1.format(y="log_accidents", x="log_exposure", src="surface"),
                                "risk_panel", extra=_SURFACE_CTES))
def ols_loglog(spark, d):
    """Q1 (one predictor): log accidents on log exposure per cell, closed form."""
    return round_doubles(stats.ols_one(_surface(spark, d), "log_accidents", "log_exposure"))


@query("vif_pair", with_views(f"""
SELECT 'n_events' AS feature, {_rnd('a * c / (a * c - b * b)')} AS vif FROM s
UNION ALL SELECT 'value_sum' AS feature, {_rnd('a * c / (a * c - b * b)')} AS vif FROM s""", "event_days", extra={
    "s": """SELECT sum(CAST(n_events AS DOUBLE) * n_events) AS a, sum(CAST(n_events AS DOUBLE) * value_sum) AS b,
                   sum(value_sum * value_sum) AS c FROM event_days"""}))
def vif_pair(spark, d):
    """Q2 with two predictors (closed form checkable): VIF without intercept."""
    return round_doubles(stats.vif(B.event_days(spark, d), ["n_events", "value_sum"]))


# ---------------------------------------------------------- splits & scaling ---

@query("kfold_ids", with_views("""
SELECT grid, year, week, CAST(ntile(3) OVER (ORDER BY grid, year, week) - 1 AS INTEGER) AS fold FROM weekly""",
                               "risk_panel", extra={"weekly": _WEEKLY_RAW}))
def kfold_ids(spark, d):
    """Contiguous 3-fold ids in panel order (first n mod 3 folds one larger)."""
    w = _weekly(spark, d).select("grid", "year", "week")
    return split.fold_id(w, 3, ["grid", "year", "week"])


@query("kfold_stratified", with_views("""
SELECT w.grid, w.year, w.week, w.occurrence, CAST(a.fold AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY occurrence ORDER BY grid, year, week) - 1 AS pos FROM weekly) w
JOIN (SELECT occurrence, fold,
             sum(sz) OVER (PARTITION BY occurrence ORDER BY fold) - sz AS lo, sz
      FROM (SELECT c.occurrence, f.fold,
                   floor((c.start + c.n - 1 - f.fold) / 3) - floor((c.start - 1 - f.fold) / 3) AS sz
            FROM (SELECT occurrence, n, sum(n) OVER (ORDER BY occurrence) - n AS start
                  FROM (SELECT occurrence, count(*) AS n FROM weekly GROUP BY occurrence)) c
            CROSS JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(0, 3)) f)) a
  ON w.occurrence = a.occurrence AND w.pos >= a.lo AND w.pos < a.lo + a.sz""",
                                      "risk_panel", extra={"weekly": _WEEKLY_RAW}))
def kfold_stratified(spark, d):
    """W5 with a label: the classifier CV folds (StratifiedKFold allocation)."""
    w = _weekly(spark, d).select("grid", "year", "week", "occurrence")
    return split.fold_id(w, 3, ["grid", "year", "week"], label="occurrence")


_SPECS = [{"train": (1, 23), "test": (27, 52)}, {"train": (1, 26), "test": (27, 52)}]  # the reference's specs


@query("temporal_splits", with_views("""
SELECT w.grid, w.year, w.week, s.split, s.role FROM weekly w
JOIN (VALUES (1, 'train', 1, 23), (1, 'test', 27, 52), (2, 'train', 1, 26), (2, 'test', 27, 52)) s(split, role, lo, hi)
  ON w.week BETWEEN s.lo AND s.hi""", "risk_panel", extra={"weekly": _WEEKLY_RAW}))
def temporal_splits_q(spark, d):
    """M3: (split, role) tags from overlapping / gapped week-range specs."""
    w = _weekly(spark, d).select("grid", "year", "week")
    return split.temporal_splits(w, _SPECS)


@query("cut_split", with_views("""
SELECT grid, year, week, CASE WHEN week <= 40 THEN 'early' ELSE 'late' END AS role FROM weekly""",
                               "risk_panel", extra={"weekly": _WEEKLY_RAW}))
def cut_split_q(spark, d):
    """M4: early/late cut at week 40."""
    return split.cut_split(_weekly(spark, d).select("grid", "year", "week"), 40)


@query("logo_folds", with_views("""
SELECT site, date, CAST(dense_rank() OVER (ORDER BY site) - 1 AS INTEGER) AS fold FROM count_panel""",
                                "count_panel"))
def logo_folds_q(spark, d):
    """M5: leave-one-site-out fold ids."""
    return split.logo_folds(B.count_panel(spark, d).select("site", "date"), "site")


@query("standardize_counts", with_views("""
SELECT site, date, daily_count,
       round((daily_count - avg(daily_count) OVER (PARTITION BY site))
             / CASE WHEN coalesce(stddev_pop(daily_count) OVER (PARTITION BY site), 0) = 0 THEN 1.0
                    ELSE stddev_pop(daily_count) OVER (PARTITION BY site) END, 6) AS scaled
FROM count_panel""", "count_panel"))
def standardize_counts(spark, d):
    """Per-site z-score of the daily count (population std, 0 -> 1)."""
    p = B.count_panel(spark, d).select("site", "date", "daily_count")
    return round_doubles(scaling.standardize(p, "site", "daily_count"))


@query("scale_roundtrip", with_views("""
SELECT site, date, daily_count, round(z, 6) AS scaled, round(z * sc + mu, 6) AS restored
FROM (SELECT p.site, p.date, p.daily_count, coalesce(s.mean, g.g_mean) AS mu, coalesce(s.scale, g.g_scale) AS sc,
             (p.daily_count - coalesce(s.mean, g.g_mean)) / coalesce(s.scale, g.g_scale) AS z
      FROM count_panel p LEFT JOIN s ON p.site = s.site CROSS JOIN g)""", "count_panel", extra={
    "tr": "SELECT * FROM count_panel WHERE year(date) <= 1998",
    "s": """SELECT site, avg(daily_count) AS mean,
                   CASE WHEN coalesce(stddev_pop(daily_count), 0) = 0 THEN 1.0 ELSE stddev_pop(daily_count) END AS scale
            FROM tr GROUP BY site""",
    "g": """SELECT avg(daily_count) AS g_mean,
                   CASE WHEN coalesce(stddev_pop(daily_count), 0) = 0 THEN 1.0 ELSE stddev_pop(daily_count) END AS g_scale
            FROM tr"""}))
def scale_roundtrip(spark, d):
    """Statistics fitted on the training years (global fallback for a
    site without training rows), applied to every row, then inverted."""
    p = B.count_panel(spark, d).select("site", "date", "daily_count")
    tr = p.where(F.year("date") <= 1998)
    st, gl = scaling.fit_scaler(tr, "site", "daily_count"), scaling.fit_global(tr, "daily_count")
    z = scaling.standardize(p, "site", "daily_count", stats=st, global_stats=gl)
    back = scaling.unstandardize(z, st, "site", "scaled", out="restored", global_stats=gl)
    return round_doubles(back)


@query("mean_impute", with_views("""
SELECT site, date, daily_count, round(coalesce(price, (SELECT avg(price) FROM gappy_panel WHERE year(date) <= 1998)), 6) AS price
FROM gappy_panel WHERE year(date) > 1998""", "gappy_panel"))
def mean_impute_q(spark, d):
    """M1: impute test-year gaps with training-year means."""
    g = B.gappy_panel(spark, d)
    tr, te = g.where(F.year("date") <= 1998), g.where(F.year("date") > 1998)
    return round_doubles(clean.mean_impute(tr, te, ["price"]))


_REGISTRY = {"keys": ["grid", "year", "week"], "cost": ["f_discount", "f_tax"],
             "price": ["f_price", "f_discount"], "target": ["risk", "occurrence"]}


@query("feature_projection", with_views("""
SELECT grid, year, week, round(f_discount, 6) AS f_discount, round(f_price, 6) AS f_price, occurrence FROM weekly""",
                                        "risk_panel", extra={"weekly": _WEEKLY_RAW}))
def feature_projection(spark, d):
    """P16 + P17: concatenated feature groups (duplicates kept once), then all
    columns except one."""
    w = _weekly(spark, d)
    sel = features.select_groups(w, _REGISTRY, ["keys", "cost", "price", "target"])
    return round_doubles(features.select_except(sel, ["f_tax", "risk"]))


# ---------------------------------------------------------------- geometry ---

def _geo_dir(spark) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/geojson-{uuid.uuid4().hex}"


_R = 6378137.0
_FEATURE_DDL = ("type string, properties struct<grid: bigint>, "
                "geometry struct<type: string, coordinates: array<array<array<double>>>>")


@query("geo_layer", with_views(f"""
SELECT s_suppkey AS grid, CAST(5 AS INTEGER) AS n_vertices,
       round({_R} * radians(lon - 0.5), 6) AS x_min, round({_R} * radians(lon + 0.5), 6) AS x_max,
       round({_R} * ln(tan(pi() / 4 + radians(lat - 0.5) / 2)), 6) AS y_min,
       round({_R} * ln(tan(pi() / 4 + radians(lat + 0.5) / 2)), 6) AS y_max,
       CAST(coalesce(m.accidents, 0) AS BIGINT) AS accidents, round(coalesce(m.annual_risk, 0.0), 6) AS annual_risk
FROM (SELECT s_suppkey, CAST(s_suppkey % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey % 170 - 85 AS DOUBLE) AS lat
      FROM supplier) s
LEFT JOIN (SELECT grid, accidents, annual_risk FROM surface WHERE grid NOT IN ({EXCL})) m ON s.s_suppkey = m.grid""",
                               "risk_panel", extra=_SURFACE_CTES))
def geo_layer(spark, d):
    """S2 + G2 + J3: cell polygons written as GeoJSON-seq to the shared
    checkpoint folder, scanned back, reprojected to Web Mercator with nested
    higher-order functions, and left-joined with the risk surface (cells
    without metrics get 0).  Reported as ring size and projected bounds."""
    from ..sources.io import read_geojson, write_geojson_seq
    path = _geo_dir(spark)
    write_geojson_seq(B.cell_squares(spark, d), path)
    g = geo_ops.reproject_polygons(read_geojson(spark, path, seq=True, feature_schema=_FEATURE_DDL))
    surf = panel.exclude(_surface(spark, d), "grid", B.EXCLUDED_CELLS).select("grid", "accidents", "annual_risk")
    j = joins.attach_geometry(g, surf, on="grid", fill=0)
    ring = F.col("geometry.coordinates")[0]
    xs = F.transform(ring, lambda p: p[0])
    ys = F.transform(ring, lambda p: p[1])
    out = j.select("grid", F.size(ring).alias("n_vertices"), F.array_min(xs).alias("x_min"),
                   F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"),
                   "accidents", "annual_risk")
    return round_doubles(out)


# ------------------------------------------------------------- sinks & scans ---

def _scratch(spark, tag: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("metrics_csv_roundtrip", with_views(_PER_CELL, "risk_panel", extra=_PRED_CTES))
def metrics_csv_roundtrip(spark, d):
    """K1 + S3: per-cell metrics written as a CSV directory with a header (no
    index column) and scanned back with an explicit schema."""
    from ..sources.io import read_panel, write_table
    m = round_doubles(evaluate.regression_metrics(_pred(spark, d), "risk", "predicted", by=["grid"]))
    path = _scratch(spark, "metrics-csv")
    write_table(m, path, fmt="csv")
    return read_panel(spark, path, schema=m.schema, fmt="csv")


@query("map_layer_by_week", with_views(f"""
SELECT grid, year, {_rnd('risk')} AS actual, {_rnd('predicted')} AS predicted,
       {_rnd('vmin')} AS vmin, {_rnd('vmax')} AS vmax, week
FROM {_LAYER_SQL} WHERE week >= 40""", "risk_panel", extra=_PRED_CTES))
def map_layer_by_week(spark, d):
    """R8 + K1 + F8: the map layer written partitioned by week (one folder per
    week instead of a loop of files) and read back with partition discovery."""
    from ..sources.io import read_panel, write_table
    layer = round_doubles(risk.map_layer(_written_back(spark, d), min_week=40))
    path = _scratch(spark, "map-layer")
    write_table(layer, path, partition_by=["week"])
    return read_panel(spark, path).withColumn("week", F.col("week").cast("int"))
