"""Model queries (MLlib learners, search, selection, explanation) and the
approximate/hashed variants: rows-only checks (no SQL oracle can say them).

Model sizes are parameters; the registered queries use small forests so the
check stays quick, but every query reads the whole tables.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import clean, evaluate, explain, features, learn, panel, risk, scaling, split, stats
from . import bindings as B
from ..session import cut_lineage, materialize
from .catalog import query, round_doubles
from .oracle import exact_mean, products, student_p, swept, with_views
from .queries_core import _SURFACE_CTES, TEST, TRAIN, _weekly

WEEKLY_FEATS = ["f_discount", "f_tax", "f_price", "exposure"]
#: The regressor predicts accidents by exposure, so exposure is no feature of it.
RISK_FEATS = [c for c in WEEKLY_FEATS if c != "exposure"]
COUNT_FEATS = ["day_of_week", "day_of_month", "month", "weekend", "is_holiday", "season_fall",
               "season_spring", "season_summer", "season_winter", "week", "price"]
SMALL_FOREST = {"numTrees": 20, "maxDepth": 6}


def _split2(spark, d):
    w = materialize(_weekly(spark, d))  # model input read many times: materialise once
    return panel.week_between(w, *TRAIN), panel.week_between(w, *TEST)


def _count_frame(spark, d):
    """Stage-1 frame: site x day counts, calendar features, interpolated price."""
    p = B.gappy_panel(spark, d)
    p = clean.interpolate(p, ["price"], ["date"], ["site"])
    p = features.calendar_parts(p, "date", holidays=(), recurring=cal.RECURRING_HOLIDAYS)
    return features.season_dummies(p)


def _fit_predict(tr, te, est, feats):
    a_tr, a_te = learn.assemble(tr, feats), learn.assemble(te, feats)
    return est.fit(a_tr).transform(a_te)


@query("forest_temporal")
def forest_temporal(spark, d):
    """L2 + M1 + M3: forest regressor on training weeks (mean-imputed), risk
    predicted for the test weeks."""
    tr, te = _split2(spark, d)
    te = clean.mean_impute(tr, te, RISK_FEATS)
    tr = clean.mean_impute(tr, tr, RISK_FEATS)
    pred = _fit_predict(tr, te, learn.forest("risk", **SMALL_FOREST), RISK_FEATS)
    return round_doubles(pred.select("grid", "year", "week", "risk", "prediction"))


@query("forest_temporal_metrics")
def forest_temporal_metrics(spark, d):
    """E1 + E2 + E4 + E5 on the forest's test predictions."""
    p = forest_temporal(spark, d)
    m = evaluate.nonzero_metrics(p, "risk", "prediction")
    return round_doubles(m.crossJoin(evaluate.smape_by_zero(p, "risk", "prediction").select("smape_zero")))


@query("classifier_temporal")
def classifier_temporal(spark, d):
    """L3 + E3: forest classifier of weekly occurrence; confusion counts,
    precision, recall, F1 of the positive class."""
    tr, te = _split2(spark, d)
    pred = _fit_predict(tr, te, learn.forest_classifier("occurrence", **SMALL_FOREST), WEEKLY_FEATS)
    return evaluate.class_metrics(pred, "occurrence", "prediction")


@query("model_leaderboard")
def model_leaderboard(spark, d):
    """L1 + L2 + L4 + L5 + C1 + E8: four learners on the same split, test
    predictions unioned with a model column, one metric row per model."""
    tr, te = _split2(spark, d)
    a_tr, a_te = learn.assemble(tr, RISK_FEATS), learn.assemble(te, RISK_FEATS)
    models = {"linear": learn.linear("risk"), "forest": learn.forest("risk", **SMALL_FOREST),
              "gbt": learn.gbt("risk", maxIter=20), "gbt_sub": learn.gbt_sub("risk", maxIter=20, maxDepth=4)}
    preds = [m.fit(a_tr).transform(a_te).select(F.lit(name).alias("model"), "risk", "prediction")
             for name, m in models.items()]
    return round_doubles(evaluate.leaderboard(evaluate.union_folds(*preds), "model", "risk", "prediction"))


@query("grid_search")
def grid_search_q(spark, d):
    """H1 + W5: grid search of the classifier scored by positive-class F1 over
    three stratified contiguous folds (the classifier form of the fold ids)."""
    tr, _ = _split2(spark, d)
    tr = split.fold_id(tr, 3, ["grid", "year", "week"], label="occurrence")
    a = learn.assemble(materialize(tr), WEEKLY_FEATS)
    est = learn.forest_classifier("occurrence", numTrees=10)
    cv = learn.grid_search(a, est, {"maxDepth": [3, 6], "minInstancesPerNode": [1, 2]},
                           learn.f1_evaluator("occurrence"), fold="fold")
    return spark.createDataFrame(learn.cv_table(cv), "params string, f1 double")


@query("random_search")
def random_search_q(spark, d):
    """H2 + M5: seeded random sample of a forest grid, cross-validated over
    whole-site folds, scored by MAE of the per-site scaled count."""
    p = scaling.standardize(_count_frame(spark, d), "site", "daily_count", out="scaled")
    p = split.group_kfold(p, "site", 3)
    a = learn.assemble(materialize(p), COUNT_FEATS)
    est = learn.forest("scaled", numTrees=10)
    grid = {"maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 2, 4], "numTrees": [5, 10]}
    cv = learn.random_search(a, est, grid, learn.regression_evaluator("scaled", "mae"), fold="fold", n_iter=3)
    return spark.createDataFrame(learn.cv_table(cv), "params string, mae double")


@query("count_model_logo")
def count_model_logo(spark, d):
    """Stage 1: per-site scaled counts (W1), exact leave-one-site-out linear
    model from per-site Gram sums (L1 + M5 + M6), predictions inverse-scaled
    with the site's statistics (W2), per-site metrics (E6)."""
    p = materialize(_count_frame(spark, d))  # read for the statistics, the triangles and the predictions
    st = scaling.fit_scaler(p, "site", "daily_count")
    z = scaling.standardize(p, "site", "daily_count", out="scaled", stats=st)
    pred = learn.logo_linear(z, COUNT_FEATS, "scaled", "site", prediction="pred_scaled")
    back = scaling.unstandardize(pred, st, "site", "pred_scaled", out="predicted")
    return round_doubles(evaluate.regression_metrics(back, "daily_count", "predicted", by=["site"]))


@query("count_model_forest")
def count_model_forest(spark, d):
    """Stage 1 with a forest: whole-site folds (M5 hashed), fold-wise fit and
    predict (M6), inverse scaling, pooled vs mean-of-sites SMAPE (E7)."""
    p = _count_frame(spark, d)
    st = scaling.fit_scaler(p, "site", "daily_count")
    z = split.group_kfold(scaling.standardize(p, "site", "daily_count", out="scaled", stats=st), "site", 5)
    a = learn.assemble(materialize(z), COUNT_FEATS)
    pred = learn.cross_predict(a, learn.forest("scaled", **SMALL_FOREST), "fold", prediction="pred_scaled")
    back = scaling.unstandardize(pred, st, "site", "pred_scaled", out="predicted")
    return round_doubles(evaluate.pooled_and_mean(back, "daily_count", "predicted", "site"))


@query("rfe_features")
def rfe_features(spark, d):
    """FS1: recursive elimination of the count features down to 5."""
    p = scaling.standardize(_count_frame(spark, d), "site", "daily_count", out="scaled")
    kept = learn.rfe(p, COUNT_FEATS, "scaled", keep=5, step=2,
                     est_factory=lambda lbl, fc: learn.forest(lbl, fc, numTrees=10, maxDepth=5))
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(kept)], "position int, feature string")


@query("rfecv_features")
def rfecv_features(spark, d):
    """FS2: elimination inside whole-site folds, size chosen by mean MAE."""
    p = scaling.standardize(_count_frame(spark, d), "site", "daily_count", out="scaled")
    p = split.group_kfold(p, "site", 3)
    chosen, scores = learn.rfecv(p, COUNT_FEATS, "scaled", "fold", step=3, min_keep=2,
                                 est_factory=lambda lbl, fc: learn.forest(lbl, fc, numTrees=10, maxDepth=5))
    rows = [(n, float(s), n == len(chosen)) for n, s in sorted(scores.items())]
    return spark.createDataFrame(rows, "n_features int, mean_mae double, chosen boolean")


def _count_forest(spark, d):
    p = scaling.standardize(_count_frame(spark, d), "site", "daily_count", out="scaled")
    p = materialize(p.select("site", "date", "scaled", *COUNT_FEATS))
    model = learn.forest("scaled", **SMALL_FOREST).fit(learn.assemble(p, COUNT_FEATS))
    return p, model


@query("impurity_importance")
def impurity_importance(spark, d):
    """X1 + T2: forest impurity importances, ranked; top 10."""
    _, model = _count_forest(spark, d)
    imp = explain.importances_df(spark, model, COUNT_FEATS)
    return round_doubles(evaluate.top_k(imp, "importance", 10, tie="feature"))


@query("permutation_importance")
def permutation_importance_q(spark, d):
    """Mean R^2 drop over 10 seeded permutations of each feature."""
    p, model = _count_forest(spark, d)
    return round_doubles(explain.permutation_importance(p, model, COUNT_FEATS, "scaled", ["site", "date"],
                                                        n_repeats=10, seed=42))


@query("block_importance")
def block_importance_q(spark, d):
    """X3 + P18: blocks of columns found by name patterns, permuted together;
    F1 drop of the occurrence classifier and SMAPE rise of the risk forest."""
    w = materialize(_weekly(spark, d))

    def blocks(feats):
        found = features.blocks_by_pattern(feats, contains={"Prices": ["price", "discount"], "Volume": ["exposure"]},
                                           exact={"Tax": ["f_tax"]})
        return {k: v for k, v in found.items() if v}

    clf = learn.forest_classifier("occurrence", **SMALL_FOREST).fit(learn.assemble(w, WEEKLY_FEATS))
    reg = learn.forest("risk", **SMALL_FOREST).fit(learn.assemble(w, RISK_FEATS))
    key = ["grid", "year", "week"]
    c = explain.block_importance(w, clf, WEEKLY_FEATS, blocks(WEEKLY_FEATS), "occurrence", key, metric="f1", seed=7)
    r = explain.block_importance(w, reg, RISK_FEATS, blocks(RISK_FEATS), "risk", key, metric="smape", seed=7)
    out = (c.select("block", F.col("importance").alias("f1_drop"))
           .join(r.select("block", F.col("importance").alias("smape_rise")), "block", "left"))
    return round_doubles(out)


@query("partial_dependence")
def partial_dependence_q(spark, d):
    """Partial dependence of the three features with the largest permutation importance, 100 points."""
    p, model = _count_forest(spark, d)
    ranking = explain.permutation_importance(p, model, COUNT_FEATS, "scaled", ["site", "date"], n_repeats=10, seed=42)
    top = [r["feature"] for r in ranking.limit(3).collect()]
    return round_doubles(explain.partial_dependence(p, model, COUNT_FEATS, top))


_GROUPS = {"calendar": ["day_of_week", "day_of_month", "month", "weekend", "is_holiday", "week"],
           "season": ["season_fall", "season_spring", "season_summer", "season_winter"],
           "price": ["price"]}


@query("group_importance")
def group_importance_q(spark, d):
    """Impurity importance summed by feature group."""
    _, model = _count_forest(spark, d)
    imp = explain.importances_df(spark, model, COUNT_FEATS)
    mapping = spark.createDataFrame([(f, g) for g, fs in _GROUPS.items() for f in fs], "feature string, group string")
    return round_doubles(explain.group_importance(imp, mapping))


def _surface_with_means(spark, d):
    p = B.risk_panel(spark, d)
    s = risk.risk_surface(p)
    return s.join(panel.cell_mean(p, "grid", list(B.PANEL_FEATURES)), "grid", "left")


_XS = ["log_exposure", *B.PANEL_FEATURES]
_MEANS_SQL = {**_SURFACE_CTES,
              "means": f"SELECT grid, {', '.join(f'{exact_mean(c)} AS {c}' for c in B.PANEL_FEATURES)} FROM risk_panel GROUP BY grid",
              "m": f"SELECT log_accidents AS y, log_exposure AS x0, {', '.join(f'coalesce({c}, 0.0) AS x{i}' for i, c in enumerate(B.PANEL_FEATURES, 1))} "
                   "FROM surface LEFT JOIN means USING (grid) WHERE log_accidents IS NOT NULL"}
_CENTRED = [*[f"x{i}" for i in range(len(_XS))], "y"]
_OLS_SQL = {
    **_MEANS_SQL,
    "centre": f"SELECT count(*) AS n, {', '.join(f'avg({c}) AS a_{c}' for c in _CENTRED)} FROM m",
    "c": f"SELECT {', '.join(f'{c} - a_{c} AS {c}' for c in _CENTRED)} FROM m, centre",
    "swept0": products("c", _CENTRED), **swept("swept0", len(_XS)),
    "s": f"SELECT * FROM swept{len(_XS)}",
    "fit": f"""SELECT n, n - {len(_XS) + 1} AS dof, (SELECT v FROM s WHERE i = {len(_XS)} AND j = {len(_XS)}) AS rss,
                      (SELECT v FROM swept0 WHERE i = {len(_XS)} AND j = {len(_XS)}) AS sst, [{', '.join(f'a_x{i}' for i in range(len(_XS)))}] AS x_mean, a_y FROM centre""",
    "terms": f"""
        SELECT {_XS}[b.i + 1] AS term, b.v AS coef, sqrt(rss / dof * v.v) AS std_err FROM s b JOIN s v ON v.i = b.i AND v.j = b.i, fit
        WHERE b.j = {len(_XS)} AND b.i < {len(_XS)}
        UNION ALL
        SELECT 'const', any_value(a_y) - (SELECT sum(v * x_mean[i + 1]) FROM s, fit WHERE j = {len(_XS)} AND i < {len(_XS)}),
               sqrt(any_value(rss) / any_value(dof) * (1.0 / any_value(n) + sum(s.v * x_mean[s.i + 1] * x_mean[s.j + 1])))
        FROM s, fit WHERE s.i < {len(_XS)} AND s.j < {len(_XS)}""",
    "ts": "SELECT term, coef, std_err, coef / std_err AS t, dof FROM terms, fit",
    **student_p("ts", "term"),
}


@query("ols_multi", with_views("""
SELECT term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(t, 6) AS t, round(p, 6) AS p_value, round(1 - rss / sst, 6) AS r2,
       round(1 - rss / fit.dof / (sst / (n - 1)), 6) AS r2_adj, n
FROM ts JOIN p_values USING (term), fit""", "risk_panel", extra=_OLS_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def ols_multi(spark, d):
    """Q1: log accidents on log exposure and the cell feature means, with
    standard errors, t and p values (NULL predictors -> 0)."""
    s = _surface_with_means(spark, d)
    return round_doubles(stats.ols(s, "log_accidents", _XS))


@query("vif_multi", with_views(f"""
SELECT {_XS}[g.i + 1] AS feature, round(g.v * s.v, 6) AS vif FROM swept0 g JOIN swept{len(_XS)} s ON s.i = g.i AND s.j = g.i WHERE g.j = g.i""",
                               "risk_panel", extra={**_MEANS_SQL, "swept0": products("m", _CENTRED[:-1]), **swept("swept0", len(_XS))}))
def vif_multi(spark, d):
    """Q2: VIF of the same predictors without intercept, highest first."""
    s = _surface_with_means(spark, d)
    return round_doubles(stats.vif(s, _XS))


_LOGO_XS = ["1", "isodow(date) - 1", "day(date)", "month(date)"]


@query("logo_linear_three", with_views(f"""
SELECT p.site, p.date, round(sum(s.v * p.x[s.i + 1]), 6) AS predicted
FROM (SELECT site, date, [{', '.join(_LOGO_XS)}] AS x FROM count_panel) p JOIN swept4 s ON s.site = p.site AND s.j = 4 AND s.i < 4 GROUP BY p.site, p.date""",
                                       "count_panel", extra={
    "own": products("count_panel", [f"CAST({x} AS DOUBLE)" for x in [*_LOGO_XS, "daily_count"]], by="site"),
    "whole": "SELECT i, j, sum(v) AS v FROM own GROUP BY i, j",
    "swept0": "SELECT site, i, j, whole.v - own.v AS v FROM own JOIN whole USING (i, j)", **swept("swept0", 4, by="site")}))
def logo_linear_three(spark, d):
    """L1 + M5 + M6 with three predictors: for every site, the plane fitted to all other sites."""
    p = B.count_panel(spark, d).select("site", "date", "daily_count", F.weekday("date").alias("w"), F.dayofmonth("date").alias("d"), F.month("date").alias("m"))
    return round_doubles(learn.logo_linear(p, ["w", "d", "m"], "daily_count", "site", prediction="predicted").select("site", "date", "predicted"))


@query("impute_scale")
def impute_scale_q(spark, d):
    """M2: impute -> assemble -> scale pipeline fitted on training years,
    applied to the later years."""
    g = B.gappy_panel(spark, d)
    tr, te = g.where(F.year("date") <= 1998), g.where(F.year("date") > 1998)
    cols = ["daily_count", "price"]
    g2 = {c: F.col(c).cast("double") for c in cols}
    model = learn.impute_scale(cols).fit(tr.withColumns(g2))
    out = model.transform(te.withColumns(g2))
    return out.select("site", "date", vector_to_array("features").alias("features"))


@query("box_stats_approx")
def box_stats_approx(spark, d):
    """A12 at scale: box statistics from the mergeable percentile sketch."""
    return round_doubles(stats.box_stats(B.count_panel(spark, d), "site", "daily_count", approx=True))


@query("distinct_count_approx")
def distinct_count_approx(spark, d):
    """A8 at scale: HyperLogLog++ distinct count."""
    from ..sources.io import read_table
    return panel.distinct_values(read_table(spark, d, "orders"), "o_custkey", approx=True)


# ------------------------------------------------------------- workflows ---

@query("volume_model_workflow")
def volume_model_workflow(spark, d):
    """Stage 1 end to end on the site x day count panel: interpolation,
    scaling, elimination to 6 features, random search over whole-site folds,
    fold-wise forest, per-site metrics."""
    from .workflows import volume_model
    p = B.gappy_panel(spark, d)
    p = features.season_dummies(features.calendar_parts(p, "date", holidays=(), recurring=cal.RECURRING_HOLIDAYS))
    out = volume_model(p, site="site", date="date", target="daily_count", feature_cols=COUNT_FEATS,
                       gap_cols=["price"], keep=6, step=3, folds=5,
                       search_grid={"maxDepth": [4, 6], "minInstancesPerNode": [1, 4]}, n_iter=2,
                       forest_params={"numTrees": 10, "maxDepth": 5}, explain_model=False)
    return round_doubles(out["per_group"])


#: Trees of the registered comparisons (the reference: 100, and one fold a group).
SMALL_COMPARISON = {"params": {"numTrees": 10, "maxIter": 10}, "group_folds": 3,
                    "learners": {"LinearRegression": (learn.linear, {}), "RandomForest": (learn.forest, {"maxDepth": [5, 8]}),
                                 "GBR": (learn.gbt, {"maxDepth": [3, 5]}), "XGBoost": (learn.gbt_sub, {"maxDepth": [3, 5]})}}


@query("compare_learners_weekly")
def compare_learners_weekly(spark, d):
    """Stage 2's comparison: four learners tuned on the early weeks, whole cells held out, leaderboard."""
    from .workflows import compare_learners
    w = panel.week_between(_weekly(spark, d), 1, 40).select("grid", "year", "week", *RISK_FEATS, "risk")
    w = cut_lineage(w)  # read for the means, the ranges of the folds and the rows
    return round_doubles(compare_learners(w, features=RISK_FEATS, label="risk", group="grid", order=["grid", "year", "week"],
                                          **SMALL_COMPARISON)["leaderboard"])


@query("compare_learners_counts")
def compare_learners_counts(spark, d):
    """Stage 1's comparison: per-site scaled counts, whole sites held out, predictions scaled back by the site."""
    from .workflows import compare_learners
    p = materialize(_count_frame(spark, d))
    st = scaling.fit_scaler(p, "site", "daily_count")
    z = scaling.standardize(p, "site", "daily_count", out="scaled", stats=st)

    def back(rows):
        return scaling.unstandardize(rows, st, "site", "prediction", out="predicted").withColumn("true", F.col("daily_count"))

    return round_doubles(compare_learners(z, features=COUNT_FEATS, label="scaled", group="site", order=["site", "date"], back=back,
                                          **SMALL_COMPARISON)["leaderboard"])


@query("search_scores")
def search_scores(spark, d):
    """H1 side by side against the same fits one after another: score of every candidate and fold, both ways."""
    tr, _ = _split2(spark, d)
    tr = split.fold_id(tr, 3, ["grid", "year", "week"])
    grid, evaluator = {"maxDepth": [2, 4]}, learn.regression_evaluator("risk", "mae")
    est = learn.forest("risk", numTrees=5)
    serial = []
    with learn.fit_input(materialize(tr), RISK_FEATS) as a:
        table = learn.grid_search(a, est, grid, evaluator, fold="fold").table(spark)
        for m in learn.param_maps(est, grid):
            for k in range(3):
                model = est.copy(m).fit(a.where(F.col("fold") != k))
                serial.append((learn.map_text(m), k, float(evaluator.evaluate(model.transform(a.where(F.col("fold") == k))))))
    serial = spark.createDataFrame(serial, "params string, fold int, serial_score double")
    return table.join(serial, ["params", "fold"], "full").withColumn("same", F.abs(F.col("score") - F.col("serial_score")) < 1e-9)


@query("risk_model_workflow")
def risk_model_workflow(spark, d):
    """Stage 2 end to end: weekly risk, the reference's two temporal splits,
    imputation, a grid-searched forest classifier and a forest regressor,
    metrics per split."""
    from .queries_core import _SPECS
    from .workflows import risk_model
    out = risk_model(B.risk_panel(spark, d), specs=_SPECS, feature_cols=list(B.PANEL_FEATURES),
                     exclude=B.EXCLUDED_CELLS, classifier_grid={"maxDepth": [3, 5]},
                     forest_params={"numTrees": 10, "maxDepth": 5}, write_back_split=2, map_from_week=40)
    return round_doubles(out["metrics"])


@query("safety_workflow")
def safety_workflow(spark, d):
    """Safety in numbers end to end: surface, correlations, OLS, VIF (OLS table returned)."""
    from .workflows import safety_in_numbers
    out = safety_in_numbers(B.risk_panel(spark, d), feature_cols=list(B.PANEL_FEATURES))
    return round_doubles(out["ols"])
