"""The reference's three analyses as end-to-end plans over Spark DataFrames.

* ``volume_model``   - stage 1: per-site count model, leave-one-group-out.
* ``risk_model``     - stage 2: weekly exposure-adjusted risk, temporal hold-out.
* ``safety_in_numbers`` - per-cell risk surface, correlation, OLS, VIF.

Each returns a dict of DataFrames (tables a user would write with
``sources.io.write_table``).  Column names are parameters; nothing about the
driver's test tables is assumed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, clean, evaluate, explain, features, joins, learn, panel, risk, scaling, split, stats
from ..session import materialize
from ..sources.io import metrics_long


def prepare_count_panel(raw: DataFrame, *, date: str = "Date", site: str = "grid", group_col: str = "GroupType",
                        group_value: str | None = "SG", weather=("tavg", "tmin", "tmax", "wspd", "pres", "wdir", "wpgt"),
                        speed_col: str = "max_speed", speed_unit: str = "mph", categoricals=("Borough", "Names"),
                        sentinel: str = "none", holidays=None, order_key: str | None = None) -> DataFrame:
    """Stage-1 preparation of a site x day count panel: calendar parts and
    season dummies (P1-P7), group filter (F1), weather gaps interpolated per
    site in date order (W4), unit-suffixed speed parsed (P9), categoricals
    one-hot with the first level dropped (P8), sentinel strings to NULL (P11),
    remaining NULLs to 0 (P12).  Columns that are absent are skipped."""
    from ..functions import calendar as cal

    p = raw.withColumn(date, cal.to_day(date))
    p = features.calendar_parts(p, date, holidays=cal.REFERENCE_HOLIDAYS if holidays is None else holidays)
    p = features.season_dummies(p)
    if group_value is not None and group_col in p.columns:
        p = p.where(F.col(group_col) == group_value)
    gaps = [c for c in weather if c in p.columns]
    if gaps:
        p = clean.interpolate(p, gaps, [order_key or date], [site])
    if speed_col in p.columns:
        p = clean.strip_units(p, [speed_col], speed_unit)
    p = clean.one_hot(p, [c for c in categoricals if c in p.columns], drop_first=True)
    p = clean.sentinel_to_null(p, value=sentinel)
    return clean.fill_zero(p)


def volume_model(panel: DataFrame, *, site: str, date: str, target: str, feature_cols,
                 order_key=None, gap_cols=(), exclude=(), keep: int | None = None, step: int = 1,
                 search_grid: dict | None = None, n_iter: int = 20, folds: int | None = None,
                 forest_params: dict | None = None, n_repeats: int = 10, top_pd: int = 3,
                 explain_model: bool = True, leak_free: bool = True, seed: int = 42) -> dict:
    """Stage 1.  Gap interpolation (W4) per site in date order, exclusion (F3),
    per-site target scaling (W1), optional elimination to ``keep`` features
    (FS1), seeded random search over group folds (H2), fold-wise prediction
    (M6) inverse-scaled per site (W2/W3), per-site and pooled metrics
    (E6/E7), impurity importances (X1) and, with ``explain_model``,
    permutation importance (X2) and partial dependence (X4).

    ``folds=None`` is leave-one-site-out; an integer hashes whole sites into
    that many folds (for many sites).  ``leak_free`` inverse-scales a held-out
    site's predictions with the statistics of the rows outside its fold; the
    reference uses the held-out site's own statistics (``leak_free=False``)."""
    forest_params = dict(forest_params or {"numTrees": 50, "maxDepth": 10})
    feats = list(feature_cols)
    p = panel
    if exclude:
        p = p.where(~F.col(site).isin(list(exclude)) | F.col(site).isNull())
    if gap_cols:
        p = clean.interpolate(p, list(gap_cols), [order_key or date], [site])
    p = p.na.drop(subset=feats + [target])
    st = scaling.fit_scaler(p, site, target)
    gl = scaling.fit_global(p, target)
    p = scaling.standardize(p, site, target, out="_scaled", stats=st, global_stats=gl)
    p = split.logo_folds(p, site) if folds is None else split.group_kfold(p, site, folds)
    p = materialize(p)  # read by every fit: materialise once
    out: dict[str, DataFrame] = {}
    spark = p.sparkSession
    if keep is not None and keep < len(feats):
        feats = learn.rfe(p, feats, "_scaled", keep=keep, step=step,
                          est_factory=lambda lbl, fc: learn.forest(lbl, fc, seed=seed, **forest_params))
    out["selected"] = spark.createDataFrame([(i + 1, f) for i, f in enumerate(feats)], "position int, feature string")
    a = learn.assemble(p, feats)
    best = dict(forest_params)
    if search_grid:
        cv = learn.random_search(a, learn.forest("_scaled", seed=seed, **forest_params), search_grid,
                                 learn.regression_evaluator("_scaled", "mae"), fold="fold", n_iter=n_iter, seed=seed)
        out["search"] = spark.createDataFrame(learn.cv_table(cv), "params string, mae double")
        best_map = cv.getEstimatorParamMaps()[int(min(range(len(cv.avgMetrics)), key=lambda i: cv.avgMetrics[i]))]
        best.update({prm.name: v for prm, v in best_map.items()})
    est = learn.forest("_scaled", seed=seed, **best)
    pred = learn.cross_predict(a, est, "fold", prediction="_pred_scaled")
    if leak_free:
        oof = scaling.fit_out_of_fold(p, "fold", target)
        back = scaling.unstandardize(pred, oof, "fold", "_pred_scaled", out="predicted")
    else:
        back = scaling.unstandardize(pred, st, site, "_pred_scaled", out="predicted", global_stats=gl)
    out["predictions"] = back.select(site, date, F.col(target).alias("true"), "predicted")
    out["per_group"] = evaluate.regression_metrics(back, target, "predicted", by=[site])
    out["pooled"] = evaluate.pooled_and_mean(back, target, "predicted", site)
    final = est.fit(a)
    out["importance"] = explain.importances_df(spark, final, feats)
    if not explain_model:
        return out
    out["permutation"] = explain.permutation_importance(p, final, feats, "_scaled", [site, date],
                                                        n_repeats=n_repeats, seed=seed)
    top = [r["feature"] for r in out["permutation"].limit(top_pd).collect()]
    out["partial_dependence"] = explain.partial_dependence(p, final, feats, top)
    return out


#: The learners that the reference compares, with the parameters it searches (fixed values); None is MLlib's deepest tree.
LEARNERS = {
    "LinearRegression": (learn.linear, {}),
    "RandomForest": (learn.forest, {"maxDepth": [5, 10, learn.MAX_DEPTH]}),
    "GBR": (learn.gbt, {"maxDepth": [3, 5]}),
    "XGBoost": (learn.gbt_sub, {"maxDepth": [3, 5]}),
}


def compare_learners(frame: DataFrame, *, features, label: str, group: str, order, learners: dict | None = None,
                     cv_folds: int = 3, group_folds: int | None = None, params: dict | None = None, back=None,
                     path: str | None = None, width: int = 4, seed: int = 42) -> dict:
    """The four-learner comparison of either stage: each learner is tuned by a grid search over contiguous
    folds (MAE), then predicts every group from a model of the others (``group_folds`` None: one fold a group),
    and a leaderboard (E8) ranks the pooled predictions.

    Text features are coerced, gaps filled with the column means (M1).  ``back(predictions)`` may map scaled
    predictions to ``true`` and ``predicted`` (stage 1); without it they are the label's own.  ``params`` are set on
    every learner that has them (e.g. numTrees).  With ``path`` all fits are kept there, and a later run goes on.

    Trees are fitted on cells where the rows outnumber these (``operators.cells``)."""
    feats, spark = list(features), frame.sparkSession
    kept = None if back else list(dict.fromkeys([group, label]))  # what the leaderboard needs; ``back`` may need any column
    p = clean.to_numeric(frame, feats)
    p = clean.mean_impute(p, p, feats)
    p = split.fold_id(p, cv_folds, list(order), name="_cv")
    p = split.group_kfold(p, group, group_folds, name="_group") if group_folds else split.logo_folds(p, group, name="_group")
    tuned, predicted = [], []
    made = {}
    for name, (make, grid) in (learners or LEARNERS).items():
        est = make(label) if name == "LinearRegression" else make(label, seed=seed)
        made[name] = est.copy({est.getParam(k): v for k, v in (params or {}).items() if est.hasParam(k)}), grid
    with learn.fit_input(materialize(p), feats) as a:
        fit = cells.Fits(a, feats, label, [est for est, _ in made.values()])
        for name, (est, grid) in made.items():
            if grid:
                search = learn.grid_search(a, est, grid, learn.regression_evaluator(label, "mae"), fold="_cv",
                                           parallelism=width, path=path and f"{path}/{name}/search", fit=fit)
                est = est.copy(search.getEstimatorParamMaps()[search.best])
                tuned += [(name, *row) for row in learn.cv_table(search)]
            rows = learn.cross_predict(a, est, "_group", path=path and f"{path}/{name}/folds", width=width, fit=fit, columns=kept)
            rows = back(rows) if back else rows.withColumns({"true": F.col(label), "predicted": F.col("prediction")})
            predicted.append(rows.select(F.lit(name).alias("model"), group, "true", "predicted"))
    predictions = evaluate.union_folds(*predicted)
    return {"search": spark.createDataFrame(tuned, "model string, params string, mae double"), "predictions": predictions,
            "leaderboard": evaluate.leaderboard(predictions, "model", "true", "predicted")}


def risk_model(day_panel: DataFrame, *, specs, feature_cols, cell: str = "grid", date: str = "date",
               accident: str = "accident", exposure: str = "exposure", scale: float = 1000.0,
               exclude=(), classifier_grid: dict | None = None, regressor_grid: dict | None = None,
               forest_params: dict | None = None, cv_folds: int = 3, write_back_split: int | None = None,
               map_from_week: int | None = None, seed: int = 42) -> dict:
    """Stage 2.  Weekly roll-up with exposure-adjusted risk and occurrence
    label (R1, A1-A2, P13, P19), exclusion (F3), then per temporal split
    (M3): mean imputation fitted on train (M1), forest classifier and
    regressor tuned by CV over stratified / contiguous folds (H1, W5; F1 of
    the positive class / MAE), confusion matrix (A14), class and regression metrics (E3-E5),
    optional write-back of one split's predictions (J6) and map layer (R8)."""
    forest_params = dict(forest_params or {"numTrees": 100, "maxDepth": 10})
    feats = list(feature_cols)
    day_panel = clean.to_numeric(day_panel, feats)  # text columns such as '30 mph' have no number: NULL, imputed below
    weekly = risk.weekly_risk(day_panel, cell=cell, date=date, accident=accident, exposure=exposure,
                              features=feats, scale=scale, exclude_cells=exclude)
    weekly = materialize(weekly)
    keys = [cell, "year", "week"]
    out: dict[str, DataFrame] = {"weekly": weekly}
    metric_rows = []
    for i, sp in enumerate(specs, 1):
        tr = weekly.where(F.col("week").between(*sp["train"]))
        te = weekly.where(F.col("week").between(*sp["test"]))
        te = clean.mean_impute(tr, te, feats)
        tr = clean.mean_impute(tr, tr, feats)
        # classifier CV folds are stratified by the label, regressor folds plain contiguous
        tr = split.fold_id(split.fold_id(tr, cv_folds, keys), cv_folds, keys, label="occurrence", name="sfold")
        a_te = learn.assemble(te, feats)
        clf = learn.forest_classifier("occurrence", seed=seed, **forest_params)
        reg = learn.forest("risk", seed=seed, **forest_params)
        with learn.fit_input(materialize(tr), feats) as a_tr:
            if classifier_grid:
                clf = learn.grid_search(a_tr, clf, classifier_grid, learn.f1_evaluator("occurrence"), fold="sfold").bestModel
            else:
                clf = clf.fit(a_tr)
            if regressor_grid:
                reg = learn.grid_search(a_tr, reg, regressor_grid, learn.regression_evaluator("risk", "mae"),
                                        fold="fold").bestModel
            else:
                reg = reg.fit(a_tr)
        cp = clf.transform(a_te).select(*keys, "occurrence", F.col("prediction").cast("int").alias("predicted_label"))
        rp = reg.transform(a_te).select(*keys, "risk", F.col("prediction").alias("predicted"))
        out[f"confusion_{i}"] = stats.confusion(cp, "occurrence", "predicted_label")
        cm = evaluate.class_metrics(cp, "occurrence", "predicted_label")
        rm = evaluate.nonzero_metrics(rp, "risk", "predicted").crossJoin(
            evaluate.smape_by_zero(rp, "risk", "predicted").select("smape_zero"))
        metric_rows.append(metrics_long(cm.crossJoin(rm)).withColumn("split", F.lit(i)))
        if write_back_split == i:
            out["write_back"] = weekly.join(rp.select(*keys, "predicted"), keys, "left")
            # the whole panel, training weeks included: the colour bounds cover every week
            layer_src = out["write_back"].withColumnRenamed("risk", "actual")
            out["map_layer"] = risk.map_layer(layer_src, keys=keys, cell=cell, min_week=map_from_week)
    out["metrics"] = evaluate.union_folds(*metric_rows)
    return out


def safety_in_numbers(day_panel: DataFrame, *, cell: str = "grid", date: str = "date", accident: str = "accident",
                      exposure: str = "exposure", feature_cols=(), geo: DataFrame | None = None) -> dict:
    """Per-cell risk surface (R4-R7), raw and log-log correlation (A13),
    log-log OLS with the cell feature means (Q1) and their VIF (Q2).  With a
    geometry layer (J3) all of its cells take part, those without data as 0
    (whose log1p is 0, as for the others)."""
    surf = risk.risk_surface(day_panel, cell=cell, date=date, accident=accident, exposure=exposure)
    feats = list(feature_cols)
    if feats:
        means = panel.cell_mean(day_panel.withColumns({c: F.col(c).try_cast("double") for c in feats}), cell, feats)
        surf = surf.join(means, cell, "left")
    if geo is not None:
        surf = joins.attach_geometry(geo.select(cell), surf, on=cell)
    out = {"surface": surf,
           "correlation": stats.pearson(surf, [("total_exposure", "accidents"), ("log_exposure", "log_accidents")]),
           "ols": stats.ols(surf, "log_accidents", ["log_exposure", *feats]),
           "vif": stats.vif(surf, ["log_exposure", *feats])}
    if geo is not None:
        out["layer"] = geo.join(surf, cell, "left")
    return out
