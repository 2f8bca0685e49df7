import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gridrisk.operators import geo as geo_ops
from gridrisk.operators import joins
from gridrisk.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="gridrisk-test-", dir="/tmp")


def test_csv_scan_with_schema_and_nan(spark):
    d = _tmp()
    with open(os.path.join(d, "panel.csv"), "w") as f:
        f.write("grid,Date,Predicted Daily Count,Aged 65+_2013\n1,2023-01-02,NaN,3\n2,2023-01-03,4.5,\n")
    df = io.read_panel(spark, d, schema="grid long, Date string, `Predicted Daily Count` double, `Aged 65+_2013` double",
                       fmt="csv")
    got = sorted((r[0], r[1], r[2], r[3]) for r in df.collect())
    assert got == [(1, "2023-01-02", None, 3.0), (2, "2023-01-03", 4.5, None)]


def test_csv_sink_and_metrics_long(spark):
    d = _tmp()
    m = spark.createDataFrame([(21.58, 227.51, 28)], "smape double, mae double, n long")
    long = io.metrics_long(m)
    assert {(r.metric, r.value) for r in long.collect()} == {("smape", 21.58), ("mae", 227.51), ("n", 28.0)}
    io.write_table(long, f"{d}/out", fmt="csv")
    back = io.read_panel(spark, f"{d}/out", schema="metric string, value double", fmt="csv")
    assert back.count() == 3
    io.write_table(spark.createDataFrame([(1, 40), (2, 41)], "g int, week int"), f"{d}/byweek", partition_by=["week"])
    assert sorted(os.listdir(f"{d}/byweek"))[:2] == ["_SUCCESS", "week=40"] or "week=40" in os.listdir(f"{d}/byweek")


def _square(lon, lat, h=0.5):
    ring = [[lon - h, lat - h], [lon + h, lat - h], [lon + h, lat + h], [lon - h, lat + h], [lon - h, lat - h]]
    return {"type": "Polygon", "coordinates": [ring]}


def test_geojson_collection_join_fill(spark):
    """FIXTURES 2.12: two features, one without metrics -> 0 after the left join."""
    d = _tmp()
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"grid": 1}, "geometry": _square(-0.1, 51.5)},
        {"type": "Feature", "properties": {"grid": 2}, "geometry": _square(-0.2, 51.6)}]}
    with open(os.path.join(d, "cells.geojson"), "w") as f:
        json.dump(fc, f)
    g = io.read_geojson(spark, os.path.join(d, "cells.geojson"))
    assert sorted(g.columns) == ["geometry", "grid"]
    m = spark.createDataFrame([(1, 3, 0.25)], "grid long, accidents long, risk double")
    out = {r.grid: (r.accidents, r.risk) for r in joins.attach_geometry(g, m).collect()}
    assert out == {1: (3, 0.25), 2: (0, 0.0)}
    proj = geo_ops.reproject_polygons(g).where("grid = 1").first().geometry
    x0, y0 = proj.coordinates[0][0]
    assert x0 == pytest.approx(6378137.0 * math.radians(-0.6))
    assert y0 == pytest.approx(6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(51.0) / 2)))
    assert proj.type == "Polygon"


def test_geojson_seq_roundtrip(spark):
    d = _tmp()
    df = spark.createDataFrame([(5, -1.0, 50.0)], "grid long, lon double, lat double").select(
        "grid", F.struct(F.lit("Polygon").alias("type"),
                         F.array(F.array(F.array("lon", "lat"), F.array("lon", "lat"))).alias("coordinates"))
        .alias("geometry"))
    io.write_geojson_seq(df, f"{d}/seq")
    back = io.read_geojson(spark, f"{d}/seq", seq=True)
    r = back.first()
    assert r.grid == 5 and r.geometry.coordinates[0][0] == [-1.0, 50.0]


def test_stations(spark):
    df = spark.createDataFrame([("SG01", 1.0, 2.0), ("SG01", 1.0, 2.0), ("XX", 1.0, 2.0), ("SG02", None, 2.0),
                                ("SG03", 3.0, 4.0), (None, 5.0, 6.0)], "site string, lon double, lat double")
    out = geo_ops.stations(df, site="site", lon="lon", lat="lat", valid_substring="SG", exclude=["SG03"])
    assert sorted(tuple(r) for r in out.collect()) == [("SG01", 1.0, 2.0)]


def test_geojson_with_known_schema(spark):
    d = _tmp()
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"grid": 7}, "geometry": _square(1.0, 2.0)}]}
    with open(os.path.join(d, "c.geojson"), "w") as f:
        json.dump(fc, f)
    ddl = "type string, properties struct<grid: bigint>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    g = io.read_geojson(spark, os.path.join(d, "c.geojson"), seq=False, feature_schema=ddl)
    r = g.first()
    assert r.grid == 7 and len(r.geometry.coordinates[0]) == 5


def test_collections_are_written_without_a_sort(spark):
    """Each partition is a whole FeatureCollection file; rows pass through (a sort held a whole file's rows in one task)."""
    d = _tmp()
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").alias("grid"), F.lit('a {"[,').alias("name")).alias("properties"),
                              F.struct(F.lit("Polygon").alias("type")).alias("geometry")))
    df = spark.range(0, 2500, 1, 3).union(spark.range(7)).where("id < 2000 or id > 2400").select(text.alias("value"))
    io.write_collections(df, f"{d}/all")
    files = [os.path.join(d, "all", f) for f in os.listdir(f"{d}/all") if f.startswith("part")]
    whole = [json.load(open(f)) for f in files]
    assert len(files) > 1 and {w["type"] for w in whole} == {"FeatureCollection"}
    want = sorted([*range(2000), *range(2401, 2500), *range(7)])
    assert sorted(x["properties"]["grid"] for w in whole for x in w["features"]) == want
    ddl = "type string, properties struct<grid: bigint, name: string>, geometry struct<type: string>"
    back = io.read_geojson(spark, f"{d}/all", feature_schema=ddl, split_bytes=50_000).collect()
    assert sorted(r.grid for r in back) == want and {r.name for r in back} == {'a {"[,'}
    io.write_collections(df.where("false"), f"{d}/none")
    assert io.read_geojson(spark, f"{d}/none", feature_schema=ddl, split_bytes=1000).count() == 0


def test_geo_collection_keeps_rows_without_key_and_twice(spark):
    from gridrisk.plans import queries_scale

    d = _tmp()
    spark.createDataFrame([(5,), (9,), (9,), (None,)], "o_orderkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    got = sorted((r.grid or 0, r.n_vertices) for r in queries_scale.geo_collection(spark, d).collect())
    assert got == [(0, 5), (5, 5), (9, 5), (9, 5)]
