"""Map-layer operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.geo import reproject_rings, web_mercator
from . import panel


def to_mercator(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """G1: add Web-Mercator (x, y) metres to WGS84 points."""
    mx, my = web_mercator(lon, lat)
    return df.withColumns({x: mx, y: my})


def reproject_polygons(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Polygon geometry struct (type, coordinates) reprojected to Web Mercator."""
    g = col(geometry)
    return df.withColumn(geometry, F.struct(g["type"].alias("type"),
                                            reproject_rings(g["coordinates"]).alias("coordinates")))


def stations(df: DataFrame, *, site: str, lon: str, lat: str, valid_substring: str | None = None,
             exclude=(), keep=()) -> DataFrame:
    """Station catalogue: sites matching the valid substring, with both
    coordinates present, minus an exclusion list; distinct rows."""
    out = df
    if valid_substring is not None:
        out = panel.contains_filter(out, site, valid_substring)
    out = panel.drop_null(out, [lon, lat])
    if exclude:
        out = panel.exclude(out, site, exclude)
    return panel.distinct_on(out, [site, *keep, lon, lat])
