import datetime as dt

from pyspark.sql import functions as F

from gridrisk.operators import clean, joins, panel, risk
from conftest import rows


def _day(s):
    return dt.date.fromisoformat(s)


def test_all_null_week_and_keys(spark):
    """FIXTURES 2.3: exposure all NULL -> sum 0, risk 0; NULL keys dropped."""
    df = spark.createDataFrame([
        (1, _day("2023-03-06"), 2, None), (1, _day("2023-03-07"), 0, None),
        (2, _day("2023-03-06"), 1, 4.0), (None, _day("2023-03-06"), 5, 1.0)],
        "grid long, date date, accident long, exposure double")
    out = risk.weekly_risk(df).orderBy("grid").collect()
    assert [(r.grid, r.accident, r.exposure, r.risk, r.occurrence) for r in out] == [
        (1, 2, 0.0, 0.0, 1), (2, 1, 4.0, 250.0, 1)]
    mean7 = risk.weekly_risk(df, mode="mean7").orderBy("grid").collect()
    assert mean7[0].exposure is None and mean7[0].risk == 0.0


def test_exclusion_keeps_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "g long")
    assert sorted(rows(panel.exclude(df, "g", [2, 3])), key=str) == [(1,), (None,)]
    keys = spark.createDataFrame([(2,), (3,)], "k long")
    assert sorted(rows(panel.exclude(df, "g", keys)), key=str) == [(1,), (None,)]


def test_dedup_total(spark):
    """FIXTURES 2.11."""
    d = _day("2023-01-05")
    df = spark.createDataFrame([(1, d, 1), (1, d, 1), (1, d, 2), (2, d, 0)], "grid long, date date, accident long")
    out = dict(rows(panel.deduped_total(df, "grid", "date", "accident")))
    assert out == {1: 3, 2: 0}


def test_one_hot_drop_first(spark):
    """FIXTURES 2.7: levels a, b, NULL -> one column b = 0, 1, 0."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    out = clean.one_hot(df, ["c", "missing"]).orderBy("id")
    assert out.columns == ["id", "c_b"]
    assert rows(out) == [(1, 0), (2, 1), (3, 0)]


def test_drop_all_null_and_profile(spark):
    df = spark.createDataFrame([(1, None, "none"), (2, None, "x")], "a int, b double, c string")
    assert clean.drop_all_null(df).columns == ["a", "c"]
    prof = {r.column_name: r for r in clean.profile_columns(df).collect()}
    assert prof["b"].all_null and prof["b"].n_null == 2 and prof["b"].is_numeric
    assert prof["c"].n_sentinel == 1 and not prof["c"].is_numeric
    assert clean.sentinel_to_null(df).where(F.col("c").isNull()).count() == 1


def test_fill_zero(spark):
    df = spark.createDataFrame([(None, None)], "a double, s string")
    assert rows(clean.fill_zero(df)) == [(0.0, "0")]


def test_reorder_missing_key_raises(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert [r.k for r in joins.reorder(df, "k", [3, 1, 2]).collect()] == [3, 1, 2]
    assert [(r.k, r.position) for r in joins.reorder(df, "k", [3, 1]).collect()] == [(3, 1), (1, 2)]
    import pytest
    with pytest.raises(KeyError):
        joins.reorder(df, "k", [3, 9])


def test_attach_geometry_fills(spark):
    geo = spark.createDataFrame([(1, "g1"), (2, "g2")], "grid long, geometry string")
    m = spark.createDataFrame([(1, 5, 0.5)], "grid long, accidents long, risk double")
    out = {r.grid: (r.accidents, r.risk) for r in joins.attach_geometry(geo, m).collect()}
    assert out == {1: (5, 0.5), 2: (0, 0.0)}
