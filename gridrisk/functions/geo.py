"""Web-Mercator projection as native expressions.

EPSG:3857 spherical Mercator: x = R*lon_rad, y = R*ln(tan(pi/4 + lat_rad/2)).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: WGS84 semi-major axis used by EPSG:3857 ---------------------
EARTH_RADIUS_M = 6378137.0


def _c(c) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def mercator_x(lon) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(_c(lon))


def mercator_y(lat) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2))


def web_mercator(lon, lat) -> tuple[Column, Column]:
    """G1: (x, y) in metres for WGS84 longitude/latitude in degrees."""
    return mercator_x(lon), mercator_y(lat)


def reproject_rings(coords) -> Column:
    """Polygon coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>> (rings of [lon, lat]) to metres.

    Nested higher-order ``transform`` keeps the work inside the JVM: no UDF.
    """
    return F.transform(_c(coords), lambda ring: F.transform(
        ring, lambda pt: F.array(mercator_x(pt[0]), mercator_y(pt[1]))))
