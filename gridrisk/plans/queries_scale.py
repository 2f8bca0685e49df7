"""Queries over the forms that are made for size: split FeatureCollections, dictionaries, tables of days and
keys, stored sketches, layers rewritten week by week."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import clean, features, panel, sketch
from ..session import ensure_checkpoint_dir
from ..sources.io import read_geojson, read_table, write_collections, write_weeks
from . import bindings as B
from .catalog import query, round_doubles
from .oracle import with_views


def _scratch(spark, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_FEATURE = ("type string, properties struct<grid: bigint, name: string>, "
            "geometry struct<type: string, coordinates: array<array<array<double>>>>")


@query("geo_collection", """
SELECT o_orderkey AS grid, 'cell {' || o_orderkey || '} "Feature"' AS name, 5 AS n_vertices, CAST(o_orderkey % 360 - 180.5 AS DOUBLE) AS x_min,
       CAST(o_orderkey % 170 - 84.5 AS DOUBLE) AS y_max
FROM orders""")
def geo_collection(spark, d):
    """FeatureCollection files, each read by byte ranges in several tasks.  (The one file is the reference's
    form; here each task of the scan writes one, so a table that one task scans still gives one.)"""
    key = F.col("o_orderkey")
    lon, lat = (key % 360 - 180).cast("double"), (key % 170 - 85).cast("double")
    ring = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5))])
    name = F.concat(F.lit("cell {"), key.cast("string"), F.lit('} "Feature"'))
    o = read_table(spark, d, "orders").select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(key.alias("grid"), name.alias("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))
    path = _scratch(spark, "collection")
    write_collections(o, path)
    g = read_geojson(spark, path, feature_schema=_FEATURE, split_bytes=1 << 20)
    xs, ys = F.transform(F.col("geometry.coordinates")[0], lambda p: p[0]), F.transform(F.col("geometry.coordinates")[0], lambda p: p[1])
    return g.select("grid", "name", F.size(xs).alias("n_vertices"), F.array_min(xs).alias("x_min"), F.array_max(ys).alias("y_max"))


_CLERK = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'K' || o_orderkey // 2 END"


@query("dictionary_index", f"""
SELECT o_orderkey, CASE WHEN level IS NOT NULL THEN dense_rank() OVER (ORDER BY level NULLS LAST) - 1 END AS index, n
FROM (SELECT o_orderkey, {_CLERK} AS level FROM orders), (SELECT count(DISTINCT {_CLERK}) AS n FROM orders)""")
def dictionary_index(spark, d):
    """A category with about half as many levels as rows, and NULLs: each row's level by its place in sort order."""
    level = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("K"), F.call_function("div", "o_orderkey", F.lit(2)).cast("string")))
    o, n = clean.encode(read_table(spark, d, "orders").select("o_orderkey", level.alias("level")), "level", "index", drop_source=True)
    return o.select("o_orderkey", "index", F.lit(n).cast("long").alias("n"))


_DAYS = ", ".join(f"DATE '{x}'" for x in cal.REFERENCE_HOLIDAYS)


@query("holiday_list", with_views(f"""
SELECT site, date, CAST(make_date(2023, month(date), day(date)) IN ({_DAYS}) AS INTEGER) AS is_holiday FROM count_panel
WHERE NOT (month(date) = 2 AND day(date) = 29)""", "count_panel"))
def holiday_list(spark, d):
    """P7 with the study's own list of dates; the panel's days are moved into the list's year."""
    p = B.count_panel(spark, d).where(~((F.month("date") == 2) & (F.dayofmonth("date") == 29)))
    p = p.withColumn("moved", F.make_date(F.lit(2023), F.month("date"), F.dayofmonth("date")))
    return p.select("site", "date", cal.is_holiday("moved").alias("is_holiday"))


@query("holiday_table", with_views("""
SELECT site, date, CAST(date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0) AS INTEGER) AS is_holiday
FROM count_panel""", "count_panel"))
def holiday_table(spark, d):
    """P7 with a long calendar: a table of days joined in."""
    days = read_table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderdate").alias("day"))
    return features.flag_days(B.count_panel(spark, d).select("site", "date"), "date", days, "day")


@query("exclude_table", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) OR o_custkey IS NULL""")
def exclude_table(spark, d):
    """F3 with a long list: customers of a table are left out."""
    listed = read_table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey")
    return panel.exclude_listed(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", listed, "c_custkey")


@query("week_rewrite", with_views("""
SELECT grid, date, CAST(week(date) AS INTEGER) AS week, CASE WHEN week(date) = 30 THEN accident + 100 ELSE accident END AS accident FROM risk_panel""", "risk_panel"))
def week_rewrite(spark, d):
    """A layer written by week along a space-filling key, then week 30 alone written again."""
    p = B.risk_panel(spark, d).select("grid", "date", "accident", cal.iso_week("date").alias("week"))
    p = p.withColumns({"lon": (F.col("grid") % 360 - 180).cast("double"), "lat": (F.col("grid") % 170 - 85).cast("double")})
    path = _scratch(spark, "weeks")
    write_weeks(p, path, near=("lon", "lat"))
    write_weeks(p.where("week = 30").withColumn("accident", F.col("accident") + 100), path, near=("lon", "lat"))
    return spark.read.parquet(path).select("grid", "date", F.col("week").cast("int").alias("week"), "accident")


_ERR_DISTINCT, _ERR_RANK = 0.05, 0.03


@query("merged_sketches", """
SELECT CAST(c_nationkey AS BIGINT) AS site, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, true AS distinct_ok, true AS median_ok
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def merged_sketches(spark, d):
    """Sketches by site and day written once, merged to years, and whether the estimates lie within their errors
    of the exact values (five standard errors of the count, 3 % of the ranks)."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("site"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("site", F.to_date("o_orderdate").alias("date"), "o_custkey", "o_totalprice")
    path = _scratch(spark, "sketches")
    sketch.sketches(rows, ["site", "date"], "o_custkey", "o_totalprice").write.parquet(path)
    by_year = sketch.estimates(sketch.merge(spark.read.parquet(path), ["site", F.year("date").alias("year")]), (0.5,))
    exact = rows.groupBy("site", F.year("date").alias("year")).agg(F.count_distinct("o_custkey").alias("d"))
    j = by_year.join(exact, ["site", "year"])
    ranks = rows.withColumn("year", F.year("date")).join(by_year.select("site", "year", "`q_0.5`"), ["site", "year"])
    below = ranks.groupBy("site", "year").agg(F.avg((F.col("o_totalprice") < F.col("`q_0.5`")).cast("double")).alias("lo"),
                                              F.avg((F.col("o_totalprice") <= F.col("`q_0.5`")).cast("double")).alias("hi"))
    j = j.join(below, ["site", "year"])
    near = F.abs(F.col("n_distinct") - F.col("d")) <= F.greatest(F.lit(1.0), F.lit(_ERR_DISTINCT) * F.col("d"))
    half = (F.col("lo") <= 0.5 + _ERR_RANK) & (F.col("hi") >= 0.5 - _ERR_RANK)
    return round_doubles(j.select("site", "year", "n", near.alias("distinct_ok"), half.alias("median_ok")))
