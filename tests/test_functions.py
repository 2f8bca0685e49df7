import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridrisk.functions import calendar as cal
from gridrisk.functions import exprs as fx
from gridrisk.functions import geo


def test_week_edges(spark):
    """FIXTURES 2.1: week 53, calendar-year key, ISO-year option."""
    df = spark.createDataFrame([("2020-12-31",), ("2023-01-01",), ("2023-01-02",)], "d string")
    out = df.select(cal.iso_week("d").alias("w"), cal.week_year(cal.to_day("d")).alias("y"),
                    cal.week_year(cal.to_day("d"), iso_year=True).alias("iy")).collect()
    assert [(r.w, r.y, r.iy) for r in out] == [(53, 2020, 2020), (52, 2023, 2022), (1, 2023, 2023)]


def test_weekday_weekend_season(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(0, 366, 17)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = df.select("d", cal.weekday("d").alias("wd"), cal.is_weekend("d").alias("we"),
                    cal.season("d").alias("s")).collect()
    names = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring",
             6: "summer", 7: "summer", 8: "summer", 9: "fall", 10: "fall", 11: "fall"}
    for r in out:
        assert r.wd == r.d.weekday()
        assert r.we == int(r.d.weekday() >= 5)
        assert r.s == names[r.d.month]


def test_holidays(spark):
    df = spark.createDataFrame([("2022-12-25",), ("2022-12-24",), ("1999-01-01",), (None,)], "d string")
    ref = [r[0] for r in df.select(cal.is_holiday("d")).collect()]
    rec = [r[0] for r in df.select(cal.is_holiday("d", days=(), recurring=cal.RECURRING_HOLIDAYS)).collect()]
    assert ref == [1, 0, 0, 0]
    assert rec == [1, 0, 1, 0]


def test_safe_ratio(spark):
    """FIXTURES 2.2: undefined ratios are 0; (1, 4) -> 250 per 1000."""
    df = spark.createDataFrame([(1, 0.0), (0, 0.0), (0, 5.0), (2, None), (None, 3.0), (1, 4.0)],
                               "a long, e double")
    out = [r[0] for r in df.select(fx.safe_ratio("a", "e", 1000.0)).collect()]
    assert out == [0.0, 0.0, 0.0, 0.0, 0.0, 250.0]


def test_strip_unit_and_sentinel(spark):
    """FIXTURES 2.6."""
    df = spark.createDataFrame([("none",), ("20 mph",), ("mph",), (" 30mph ",), ("abc",), (None,)], "s string")
    out = [r[0] for r in df.select(fx.strip_unit("s", "mph")).collect()]
    assert out == [None, 20.0, None, 30.0, None, None]


def test_smape_bounds(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (2.0, 2.0)], "y double, p double")
    terms = [r[0] for r in df.select(fx.smape_term("y", "p")).collect()]
    assert terms[0] == 0.0 and terms[3] == 0.0
    assert terms[1] == pytest.approx(2.0) and terms[2] == pytest.approx(2.0)


def test_residual_conventions(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "y double, p double")
    r = df.select(fx.residual("y", "p"), fx.residual("y", "p", "pred_minus_true"), fx.residual("y", "p", "abs")).first()
    assert tuple(r) == (2.0, -2.0, 2.0)
    with pytest.raises(ValueError):
        fx.residual("y", "p", "nope")


def test_mercator_matches_formula(spark):
    import math
    df = spark.createDataFrame([(0.0, 0.0), (-0.1276, 51.5072), (180.0, 85.0)], "lon double, lat double")
    x, y = geo.web_mercator("lon", "lat")
    for (lon, lat), r in zip([(0.0, 0.0), (-0.1276, 51.5072), (180.0, 85.0)], df.select(x, y).collect()):
        assert r[0] == pytest.approx(6378137.0 * math.radians(lon))
        assert r[1] == pytest.approx(6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)), abs=1e-6)
