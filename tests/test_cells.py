"""Tree regressors on cells against MLlib's own fits on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.operators import cells, learn
from gridrisk.plans import workflows

FEATS = ["a", "b", "c c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        a, b, c = float(rng.integers(0, 5)), float(rng.normal()), float(rng.choice([0.0, 0.0, 0.0, 1.5, 7.0]))
        y = 0.0 if rng.random() < 0.5 else float(a * b + 3 * c + rng.normal())
        rows.append((i, i % 3, i % 40, a, b, c, y))
    df = spark.createDataFrame(rows, "i int, fold int, g int, a double, b double, `c c` double, y double").repartition(6)
    return learn.assemble(df, FEATS).cache()


def predicted(model, df, held):
    return dict(model.transform(df.where(F.col("fold") == held)).select("i", "prediction").collect())


@pytest.mark.parametrize("make", [
    lambda: learn.gbt("y", maxIter=6, maxDepth=5, maxBins=16),
    lambda: learn.gbt("y", maxIter=5, maxDepth=3, maxBins=8, minInstancesPerNode=40, stepSize=0.5, minInfoGain=0.05),
    lambda: learn.forest("y", numTrees=1, maxDepth=6, bootstrap=False, maxBins=16, minInstancesPerNode=3),
    lambda: learn.forest("y", numTrees=3, maxDepth=10, bootstrap=False, maxBins=12),
])
def test_cells_grow_mllibs_trees(frame, make):
    est = make()
    fit = cells.Fits(frame, FEATS, "y")
    model = fit(est, "fold", 2)
    assert isinstance(model, cells.CellModel)
    rows = predicted(est.fit(frame.where("fold != 2")), frame, 2)
    got = predicted(model, frame, 2)
    assert rows.keys() == got.keys() and max(abs(rows[i] - got[i]) for i in rows) < 1e-9


def test_sums_hold_every_row(frame):
    grid = cells.grid_of(frame, FEATS, "y", 8)
    wanted = [cells.Draws("all", 1.0, 1, 0), *[cells.Draws(kind, rate, 15, 42) for kind, rate in (("poisson", 1.0), ("poisson", 0.5), ("bernoulli", 0.8))]]
    got = cells.cell_sums(frame, grid, "y", wanted)  # in two passes
    again = cells.cell_sums(frame, grid, "y", wanted[1:2])
    assert (got[wanted[1]][:, 0] == again[wanted[1]][:, 0]).all()  # the seed's own draws
    whole = got[wanted[0]][0]
    n, s, q = frame.agg(F.count("y"), F.sum("y"), F.sum(F.col("y") * F.col("y"))).first()
    assert whole.sum(axis=1) == pytest.approx([n, s, q]) and grid.rows == n
    for d in wanted[1:]:  # each draw has about rate of the rows and of the sums, and draws differ
        draws = got[d]
        assert len(draws) == 15 and len({tuple(x[0]) for x in draws}) == 15
        assert draws.sum(axis=2)[:, 0] == pytest.approx(np.full(15, d.rate * n), rel=0.12)
        assert draws.mean(axis=0).sum(axis=1) == pytest.approx(d.rate * whole.sum(axis=1), rel=0.1)


@pytest.mark.parametrize("rate", [0.5, 1.0, 3.0])
def test_draws_are_poisson(rate):
    times = cells.drawn(np.random.default_rng(1), "poisson", rate, 400_000)
    assert times.mean() == pytest.approx(rate, rel=0.01) and times.var() == pytest.approx(rate, rel=0.02)
    assert (times == 0).mean() == pytest.approx(np.exp(-rate), rel=0.01)


@pytest.mark.parametrize("make", [lambda: learn.forest("y", numTrees=20, maxDepth=5, maxBins=16),
                                  lambda: learn.gbt_sub("y", maxIter=10, maxDepth=4, maxBins=16)])
def test_drawn_trees_score_like_mllibs(frame, make):
    est = make()
    score = learn.regression_evaluator("y", "rmse")
    held = frame.where("fold = 1")
    mine = score.evaluate(cells.Fits(frame, FEATS, "y")(est, "fold", 1).transform(held))
    rows = score.evaluate(est.fit(frame.where("fold != 1")).transform(held))
    assert mine == pytest.approx(rows, rel=0.05)


def test_rows_where_cells_dont_help(spark, frame):
    est = learn.forest("y", numTrees=2, maxDepth=3)
    fit = cells.Fits(frame.limit(300), FEATS, "y")
    assert not isinstance(fit(est, "fold", 0), cells.CellModel)  # more cells than rows
    weighted = est.copy({est.weightCol: "i"})
    assert not isinstance(cells.Fits(frame.where("i > 0"), FEATS, "y")(weighted, "fold", 0), cells.CellModel)
    broken = frame.withColumn("y", F.when(F.col("i") != 7, F.col("y")))
    with pytest.raises(Exception):  # MLlib's own report of a NULL label
        cells.Fits(broken, FEATS, "y")(est, "fold", 0)


def test_unknown_values_go_where_a_tree_sends_them(spark, frame):
    est = learn.gbt("y", maxIter=3, maxBins=16)
    model, rows = cells.Fits(frame, FEATS, "y")(est, "fold", 0), est.fit(frame.where("fold != 0"))
    odd = spark.createDataFrame([(0, None, 0.1, 0.0), (1, 2.0, float("nan"), 7.0), (2, 99.0, -99.0, float("inf")), (3, 2.0, None, None)],
                                "i int, a double, b double, `c c` double")
    odd = learn.assemble(odd, FEATS)
    got = dict(model.transform(odd).select("i", "prediction").collect())
    want = dict(rows.transform(odd).select("i", "prediction").collect())
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_passes_dont_grow_with_levels(spark, frame):
    """A comparison of trees takes a few jobs a fit (it was one and more for each level of each tree: 660 here)."""
    learners = {"RandomForest": (learn.forest, {"maxDepth": [2, 8]}), "GBR": (learn.gbt, {"maxDepth": [2, 8]}),
                "XGBoost": (learn.gbt_sub, {"maxDepth": [2, 8]})}
    spark.sparkContext.setJobGroup("compare", "")
    try:
        out = workflows.compare_learners(frame.drop("features", "fold"), features=FEATS, label="y", group="g", order=["i"], learners=learners,
                                         params={"numTrees": 6, "maxIter": 6, "maxBins": 8}, group_folds=3)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("compare"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    board = {r["model"]: r for r in out["leaderboard"].collect()}
    assert all(board[m]["n"] == 4000 and board[m]["r2"] > 0.2 for m in learners)
    assert out["search"].count() == 6 and out["predictions"].columns == ["model", "g", "true", "predicted"]
    assert jobs < 250
