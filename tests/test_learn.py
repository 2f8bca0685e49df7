import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gridrisk.operators import explain, features, learn


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(6):
        for t in range(40):
            a, b, u = rng.normal(), rng.normal(), rng.normal()
            rows.append((g, t, float(a), float(b), float(u), float(1 + 2 * a - b + 0.3 * g + rng.normal(0, 0.1))))
    return spark.createDataFrame(rows, "g int, t int, a double, b double, unused double, y double").cache()


def test_logo_linear_equals_refit(spark, frame):
    pred = learn.logo_linear(frame, ["a", "b"], "y", "g")
    for held in (0, 3):
        train = learn.assemble(frame.where(F.col("g") != held), ["a", "b"])
        m = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(train)
        exp = m.transform(learn.assemble(frame.where(F.col("g") == held), ["a", "b"])).select("t", "prediction")
        got = pred.where(F.col("g") == held).select("t", F.col("prediction").alias("p2"))
        diff = exp.join(got, "t").select(F.max(F.abs(F.col("prediction") - F.col("p2")))).first()[0]
        assert diff < 1e-8


def test_cross_predict_covers_every_row_once(spark, frame):
    a = learn.assemble(frame, ["a", "b"])
    out = learn.cross_predict(a, learn.linear("y"), "g")
    assert out.count() == frame.count()
    assert out.select("g", "t").distinct().count() == frame.count()


def test_permutation_invariants(spark, frame):
    blocks = {"a": ["a"], "ab": ["a", "b"]}
    var = explain.permuted_variants(frame, ["g", "t"], blocks, n_repeats=2, seed=5)
    n = frame.count()
    assert var.count() == n * 4
    sums = var.groupBy("_pv_block", "_pv_rep").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"),
                                                     F.count(F.lit(1)).alias("n")).collect()
    base = frame.agg(F.sum("a"), F.sum("b")).first()
    for r in sums:
        assert r.n == n and r.sa == pytest.approx(base[0]) and r.sb == pytest.approx(base[1])
    # the block moves together: (a, b) pairs are preserved as pairs
    pairs = {(round(r.a, 12), round(r.b, 12)) for r in frame.collect()}
    moved = var.where("_pv_block = 'ab'").collect()
    assert all((round(r.a, 12), round(r.b, 12)) in pairs for r in moved)
    assert sum(1 for r in var.where("_pv_block = 'a'").collect()) == 2 * n


def test_permuting_unused_feature_changes_nothing(spark, frame):
    a = learn.assemble(frame, ["a", "b", "unused"])
    model = learn.linear("y").fit(a)
    model_coef = model.coefficients.toArray()
    model.coefficients  # noqa: B018
    forest = learn.forest("y", numTrees=5, maxDepth=3).fit(learn.assemble(frame, ["a", "b"]))
    imp = dict(explain.importances(forest, ["a", "b"]))
    assert sum(imp.values()) == pytest.approx(1.0)
    assert imp["a"] > imp["b"] >= 0
    # a forest that never sees 'unused': permuting it leaves the score unchanged
    res = {r.feature: r.importance for r in
           explain.permutation_importance(frame, forest, ["a", "b"], "y", ["g", "t"], n_repeats=2).collect()}
    assert res["a"] > 0
    assert len(model_coef) == 3


def test_rfe_keeps_informative(spark, frame):
    kept = learn.rfe(frame, ["a", "b", "unused"], "y", keep=2, step=1,
                     est_factory=lambda l, f: learn.forest(l, f, numTrees=10, maxDepth=4))
    assert set(kept) == {"a", "b"}


def test_blocks_by_pattern():
    cols = ["tavg", "landuse_park_pct_250m", "bike_lane_length_250m", "Mean_inclome_2012/13", "Aged 65+_2013",
            "Borough_Camden", "sum_predicted_daily_count"]
    b = features.blocks_by_pattern(cols, contains={"Landuse": ["landuse_"], "Demographics": ["pop_dens", "income", "Aged"],
                                                   "Borough": ["Borough_"]},
                                   exact={"Weather": ["tavg", "tmin"], "Volume": ["sum_predicted_daily_count"]})
    assert b["Weather"] == ["tavg"] and b["Landuse"] == ["landuse_park_pct_250m"]
    assert b["Demographics"] == ["Aged 65+_2013"]  # 'income' never matches the misspelt column
    assert b["Borough"] == ["Borough_Camden"] and b["Volume"] == ["sum_predicted_daily_count"]


def test_partial_dependence_grid(spark, frame):
    model = learn.forest("y", numTrees=5, maxDepth=3).fit(learn.assemble(frame, ["a", "b"]))
    pd_ = explain.partial_dependence(frame, model, ["a", "b"], ["a"], points=5).collect()
    assert len(pd_) == 5 and pd_[0].mean_prediction < pd_[-1].mean_prediction
