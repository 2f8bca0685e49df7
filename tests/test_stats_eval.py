import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.operators import evaluate, stats


def test_histogram_edges(spark):
    """FIXTURES 2.10: max in last bin; empty bins 0; NumPy bins."""
    vals = [0.0, 0.1, 0.1, 0.5, 1.0, 1.0, 7.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = stats.histogram(df, "x", 5).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=5)
    assert [r["count"] for r in h] == list(counts)
    assert [r.edge_lo for r in h] == pytest.approx(list(edges[:-1]))
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    hc = stats.histogram(const, "x", 4).orderBy("bin").collect()
    c2, e2 = np.histogram([2.0, 2.0], bins=4)
    assert [r["count"] for r in hc] == list(c2)


def test_box_stats_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.integers(0, 50, 37)] + [("b", float(v)) for v in rng.normal(0, 1, 11)] + \
           [("b", 25.0), ("one", 4.0)]
    df = spark.createDataFrame(data, "k string, x double")
    for approx in (False,):
        out = {r.k: r for r in stats.box_stats(df, "k", "x", approx=approx).collect()}
        for k in ("a", "b", "one"):
            x = np.array([v for kk, v in data if kk == k])
            q1, med, q3 = np.percentile(x, [25, 50, 75])
            iqr = q3 - q1
            r = out[k]
            assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
            assert r.whisker_low == pytest.approx(x[x >= q1 - 1.5 * iqr].min())
            assert r.whisker_high == pytest.approx(x[x <= q3 + 1.5 * iqr].max())
            assert r.n_outliers == int(((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).sum())
        assert [out[k].label for k in ("a", "b", "one")] == [1, 2, 3]


def test_confusion_reference_split(spark):
    """The reference's split-1 matrix [[6956 3626],[0 78]] -> P 0.02, R 1.00, F1 0.04."""
    rows = [(0, 0)] * 6956 + [(0, 1)] * 3626 + [(1, 1)] * 78
    df = spark.createDataFrame(rows, "y int, p int")
    m = evaluate.class_metrics(df, "y", "p").first()
    assert (m.tn, m.fp, m.fn, m.tp) == (6956, 3626, 0, 78)
    assert round(m.precision, 2) == 0.02 and round(m.recall, 2) == 1.0 and round(m.f1, 2) == 0.04
    cm = {(r.label, r.prediction): r.n for r in stats.confusion(df, "y", "p").collect()}
    assert cm == {(0, 0): 6956, (0, 1): 3626, (1, 0): 0, (1, 1): 78}


def test_metric_edges(spark):
    """FIXTURES 2.8: empty positive class, constant truth, no non-zero rows."""
    neg = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    m = evaluate.class_metrics(neg, "y", "p").first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_metrics(const, "y", "p").first().r2 == 1.0
    off = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_metrics(off, "y", "p").first().r2 == 0.0
    zeros = spark.createDataFrame([(0.0, 0.5), (0.0, 0.0)], "y double, p double")
    nz = evaluate.nonzero_metrics(zeros, "y", "p").first()
    assert nz.n_nonzero == 0 and nz.mae_nonzero is None and nz.smape_nonzero is None


def test_regression_metrics_values(spark):
    y = np.array([3.0, -0.5, 2.0, 7.0])
    p = np.array([2.5, 0.0, 2.0, 8.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = evaluate.regression_metrics(df, "y", "p").first()
    assert m.mae == pytest.approx(np.mean(np.abs(p - y)))
    assert m.rmse == pytest.approx(np.sqrt(np.mean((p - y) ** 2)))
    assert m.r2 == pytest.approx(1 - np.sum((p - y) ** 2) / np.sum((y - y.mean()) ** 2))
    assert m.smape == pytest.approx(100 * np.mean(2 * np.abs(p - y) / (np.abs(y) + np.abs(p) + 1e-10)))


def test_ols_and_vif(spark):
    rng = np.random.default_rng(0)
    n = 60
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    x3 = x1 * 0.8 + rng.normal(scale=0.3, size=n)
    y = 1.5 + 2.0 * x1 - x2 + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(y, x1, x2, x3)], "y double, a double, b double, c double")
    one = stats.ols_one(df, "y", "a").first()
    slope, icpt = np.polyfit(x1, y, 1)
    assert (one.slope, one.intercept) == pytest.approx((slope, icpt))
    multi = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    X = np.column_stack([x1, x2, np.ones(n)])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert [multi[t].coef for t in ("a", "b", "const")] == pytest.approx(list(beta), rel=1e-6)
    resid = y - X @ beta
    cov = resid @ resid / (n - 3) * np.linalg.inv(X.T @ X)
    assert multi["a"].std_err == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-6)
    vifs = {r.feature: r.vif for r in stats.vif(df, ["a", "b", "c"]).collect()}
    Xn = np.column_stack([x1, x2, x3])
    for i, c in enumerate(["a", "b", "c"]):
        others = np.delete(Xn, i, axis=1)
        b = np.linalg.lstsq(others, Xn[:, i], rcond=None)[0]
        r2_unc = 1 - np.sum((Xn[:, i] - others @ b) ** 2) / np.sum(Xn[:, i] ** 2)
        assert vifs[c] == pytest.approx(1 / (1 - r2_unc), rel=1e-6)


def test_ols_one_degenerate_is_null_not_error(spark):
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double")
    r = stats.ols_one(two, "y", "x").first()
    assert r.slope == pytest.approx(2.0) and r.se_slope is None
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (1.0, 2.0)], "x double, y double")
    assert stats.ols_one(flat, "y", "x").first().slope is None
