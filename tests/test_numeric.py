import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.functions import exact
from gridrisk.functions.moments import moments, without
from gridrisk.operators import clean, learn, qr, scaling, stats


def test_exact_sums_are_the_same_for_any_order(spark):
    rng = random.Random(1)
    values = [rng.choice([1e15, -1e15, 1e-9, 0.1, -7.3, 1e6]) * rng.random() for _ in range(3000)] + [None]
    want = float(sum(Fraction(v) for v in values[:-1]))
    seen = set()
    for seed, parts in ((1, 1), (2, 3), (3, 8), (4, 13)):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        r = df.agg(exact.exact_sum("x").alias("s"), exact.exact_mean("x").alias("m")).first()
        seen.add((r["s"], r["m"]))
    assert len(seen) == 1
    assert abs(seen.pop()[0] - want) <= 4 * math.ulp(want)


def test_exact_sum_edges(spark):
    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(exact.exact_sum("x").alias("s"), exact.exact_mean("x").alias("m")).first()
    assert tuple(total(None, None)) == (None, None) and tuple(total()) == (None, None)
    assert total(0.1, 0.2, -0.1, -0.2)["s"] == 0.0
    assert total(2.0 ** 70, 1.0, -2.0 ** 70)["s"] == 1.0
    assert total(1e300, 1.0)["s"] == 1e300 and math.isnan(total(float("nan"), 1.0)["s"]) and total(float("inf"), 1.0)["s"] == float("inf")
    assert spark.createDataFrame([(0.04,), (0.06,), (None,)], "x double").agg(exact.scaled_mean("x", 2)).first()[0] == 0.05


def test_moments_near_a_large_mean(spark):
    rng = random.Random(2)
    rows = [(i % 4, 1e9 + rng.random()) for i in range(2000)] + [(4, None), (4, None), (5, 1e9)]
    df = spark.createDataFrame(rows, "fold int, x double").repartition(7)
    got = {r["fold"]: r for r in scaling.fit_out_of_fold(df, "fold", "x").collect()}
    for f in range(6):
        x = np.array([v for g, v in rows if g != f and v is not None])
        assert abs(got[f]["mean"] - x.mean()) < 1e-6 and abs(got[f]["scale"] - x.std()) < 1e-6
    one = spark.createDataFrame([(0, 5.0)], "fold int, x double")
    assert [tuple(r) for r in scaling.fit_out_of_fold(one, "fold", "x").collect()] == [(0, None, 1.0)]
    both = df.agg(moments("x").alias("w"), moments(F.when(F.col("fold") == 1, F.col("x"))).alias("p"))
    r = both.select(without(F.col("w"), F.col("p")).alias("r")).first()["r"]
    assert r["n"] == 1501 and r["m2"] > 0


def test_scaling_of_a_filled_column(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,)], "x double")
    got = [r["x"] for r in learn.population_scale(df, df, ["x"])[0].collect()]
    assert [round(v, 3) for v in got] == [-1.414, 0.0, 1.414, 0.0]


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    y = x @ [1.5, -0.02, 40] + 7 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(6)
    got = {r["term"]: r for r in stats.ols(df, "y", ["a", "b", "c"]).collect()}
    full = np.column_stack([np.ones(200), x])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    res = y - full @ beta
    se = np.sqrt(res @ res / 196 * np.diag(np.linalg.inv(full.T @ full)))
    for i, t in enumerate(["const", "a", "b", "c"]):
        assert abs(got[t]["coef"] - beta[i]) < 1e-8 * max(1, abs(beta[i])) and abs(got[t]["std_err"] / se[i] - 1) < 1e-6
    assert abs(got["a"]["r2"] - (1 - res @ res / ((y - y.mean()) ** 2).sum())) < 1e-10 and got["a"]["n"] == 200


def test_t_p_values():
    # fixed values from tables of the distribution
    for t, dof, p in ((12.706205, 1, 0.05), (2.228139, 10, 0.05), (1.959964, 10**7, 0.05), (3.169273, 10, 0.01), (0.0, 5, 1.0), (0.674490, 10**8, 0.5)):
        assert abs(qr.t_pvalue(t, dof) - p) < 1e-6 and qr.t_pvalue(t, dof) == qr.t_pvalue(-t, dof)
    assert 0 <= qr.t_pvalue(60.0, 30) < 1e-30


def test_ols_without_inference(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 5.0), (3.0, 6.0, 8.0), (4.0, 8.0, 8.5)], "a double, b double, y double")
    dependent = {r["term"]: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    assert all(r["std_err"] is None and r["t"] is None and r["p_value"] is None for r in dependent.values())
    assert abs(dependent["b"]["coef"] / dependent["a"]["coef"] - 2) < 1e-6 and 0.9 < dependent["a"]["r2"] < 1
    two = {r["term"]: r for r in stats.ols(df.limit(2), "y", ["a"]).collect()}
    assert abs(two["a"]["coef"] - 2) < 1e-9 and two["a"]["std_err"] is None and two["a"]["r2_adj"] is None
    none = stats.ols(df.where("a > 9"), "y", ["a"]).collect()
    assert len(none) == 2 and none[0]["coef"] is None and none[0]["n"] == 0
    flat = stats.ols(df.withColumn("y", F.lit(2.5)), "y", ["a"]).collect()
    assert all(r["r2"] is None for r in flat)


def test_vif_of_dependent_and_large_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) + 1e7  # X'X in doubles would lose the difference
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = {r["feature"]: r["vif"] for r in stats.vif(df, ["a", "b"]).collect()}
    d = x[:, 0] - x[:, 1]
    want = (x[:, 0] ** 2).sum() / ((x[:, 0] - x[:, 1] * (1 + (d @ x[:, 1]) / (x[:, 1] @ x[:, 1]))) ** 2).sum()
    assert abs(got["a"] / want - 1) < 1e-3
    twice = df.withColumn("c", F.col("a") * 2).withColumn("z", F.lit(0.0))
    assert all(math.isfinite(r["vif"]) for r in stats.vif(twice, ["a", "c", "z"]).collect())


@pytest.mark.parametrize("groups", [1, 2, 33, 70])
def test_leave_one_out_triangles(spark, groups):
    rng = np.random.default_rng(groups)
    rows = [(int(g) if g else None, float(a), float(b), float(2 * a - b + g % 3 + e)) for g, a, b, e in
            zip(rng.integers(0, groups, 600), rng.normal(size=600) + 1e6, rng.normal(size=600), rng.normal(size=600), strict=True)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double").repartition(5)
    for r in learn.logo_linear(df, ["a", "b"], "y", "g").limit(200).collect():
        rest = np.array([(1.0, a, b, y) for g, a, b, y in rows if g != r["g"]]).reshape(-1, 4)
        if not len(rest):
            assert r["prediction"] == 0
            continue
        beta, *_ = np.linalg.lstsq(rest[:, :3], rest[:, 3], rcond=None)
        assert abs(r["prediction"] - np.array([1, r["a"], r["b"]]) @ beta) < 1e-4


def test_profile_of_odd_names(spark):
    df = spark.createDataFrame([(1, "none", None), (2, "x", None)], "a int, `it's` string, c string")
    twin = df.select("a", "`it's`", F.col("c").alias("a"))
    got = [(r["column_name"], r["duplicated"], r["n_null"], r["n_sentinel"], r["all_null"]) for r in clean.profile_columns(twin).collect()]
    assert got == [("a", True, 0, 0, False), ("it's", False, 0, 1, False), ("a", True, 2, 0, True)]
