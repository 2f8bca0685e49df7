"""Learners, cross-validated prediction, search and feature elimination
(M2, M6, L1-L5, H1, H2, FS1, FS2) on MLlib.

Every fit is a distributed MLlib job (``compare_learners`` fits its trees on cells where rows are many,
``operators.cells``); fits that don't depend on one another run side by side and are kept as they finish
(``operators.search``).  The Python loops here only walk parameter maps or elimination
steps (a handful of driver-side decisions), never rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.moments import filled, moments, scale_of
from ..session import cut_lineage, materialize
from .joins import side_join
from .qr import group_factors, solve, without_own
from .ranking import number_rows
from .search import WIDTH, Ledger, Search, map_text, predict_folds, side_by_side

FEATURES = "features"


# ------------------------------------------------------------- preparation ---

def assemble(df: DataFrame, features, out: str = FEATURES, handle_invalid: str = "keep") -> DataFrame:
    """Feature columns -> one vector column (NULL kept as NaN unless imputed first)."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=handle_invalid).transform(df)


@contextmanager
def fit_input(df: DataFrame, features, out: str = FEATURES) -> Iterator[DataFrame]:
    """Assembled rows that many fits read, held as columns in memory (on local disk where that is full) until the
    block ends.  A fit reads its input three times and a score once more; from a checkpoint each of these parses
    whole rows and assembles the vectors again.  Rows, their order and their partitions stay."""
    kept = assemble(df, features, out).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def impute_scale(cols, out: str = FEATURES) -> Pipeline:
    """M2: mean imputation -> vector -> centring and scaling, as one Pipeline
    fitted on training rows and applied to test rows.  MLlib's scaler divides
    by the sample deviation; ``population_scale`` gives scikit-learn's
    population form when the exact numbers matter."""
    cols = list(cols)
    imputed = [f"{c}__imp" for c in cols]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=cols, outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol=f"{out}__raw"),
        StandardScaler(inputCol=f"{out}__raw", outputCol=out, withMean=True, withStd=True),
    ])


def population_scale(train: DataFrame, test: DataFrame, cols, out: str = FEATURES):
    """M2, exact form: train means fill NULLs, columns centred and divided by the population deviation of
    the *filled* train column (0 -> 1); one aggregate, one row.

    A filled value is the mean and adds nothing to the squares about it, so the filled column's moments are
    the known values' with the count of all rows (``functions.moments``)."""
    cols = list(cols)
    st = train.agg(*[moments(col(c)).alias(f"m{i}") for i, c in enumerate(cols)], F.count(F.lit(1)).alias("rows"))
    st = cut_lineage(st.select(*[x for i in range(len(cols)) for x in (
        F.col(f"m{i}.mean").alias(f"m{i}"), scale_of(filled(F.col(f"m{i}"), F.col("rows"))).alias(f"s{i}"))]))

    def apply(df):
        j = df.crossJoin(F.broadcast(st))
        z = {c: (F.coalesce(col(c), F.col(f"m{i}")) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(cols)}
        j = j.withColumns(z).drop(*[f"m{i}" for i in range(len(cols))], *[f"s{i}" for i in range(len(cols))])
        return assemble(j, cols, out)

    return apply(train), apply(test)


# ---------------------------------------------------------------- learners ---

def linear(label: str, features: str = FEATURES, **kw) -> LinearRegression:
    """L1: ordinary least squares by the normal equations."""
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal", regParam=0.0, **kw)


#: The deepest trees that MLlib grows.
MAX_DEPTH = 30


def tree_depth(depth: int | None) -> int:
    """MLlib's limit for unbounded trees (None); a greater depth raises."""
    if depth is not None and depth > MAX_DEPTH:
        raise ValueError(f"maxDepth {depth}: trees have at most {MAX_DEPTH} levels (None: as deep as that)")
    return depth or MAX_DEPTH


def forest(label: str, features: str = FEATURES, numTrees: int = 100, maxDepth: int | None = None,
           minInstancesPerNode: int = 1, featureSubsetStrategy: str = "all", seed: int = 42,
           **kw) -> RandomForestRegressor:
    """L2: random-forest regressor; every feature considered at each split
    (scikit-learn's old regressor default); ``maxDepth`` None is MLlib's deepest."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=numTrees,
                                 maxDepth=tree_depth(maxDepth), minInstancesPerNode=minInstancesPerNode,
                                 featureSubsetStrategy=featureSubsetStrategy, seed=seed, **kw)


def forest_classifier(label: str, features: str = FEATURES, numTrees: int = 100, maxDepth: int | None = None,
                      minInstancesPerNode: int = 1, seed: int = 42, **kw) -> RandomForestClassifier:
    """L3: random-forest classifier, sqrt(k) features per split."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=numTrees,
                                  maxDepth=tree_depth(maxDepth), minInstancesPerNode=minInstancesPerNode,
                                  featureSubsetStrategy="sqrt", seed=seed, **kw)


def gbt(label: str, features: str = FEATURES, maxIter: int = 100, maxDepth: int = 3,
        stepSize: float = 0.1, seed: int = 42, **kw) -> GBTRegressor:
    """L4: gradient-boosted trees, 100 x depth 3, learning rate 0.1."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=maxIter, maxDepth=maxDepth,
                        stepSize=stepSize, seed=seed, **kw)


def gbt_sub(label: str, features: str = FEATURES, maxIter: int = 100, maxDepth: int = 3,
            stepSize: float = 0.1, subsamplingRate: float = 0.8, featureSubsetStrategy: str = "sqrt",
            seed: int = 42, **kw) -> GBTRegressor:
    """The second boosted configuration (row and feature subsampling)."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=maxIter, maxDepth=maxDepth,
                        stepSize=stepSize, subsamplingRate=subsamplingRate,
                        featureSubsetStrategy=featureSubsetStrategy, seed=seed, **kw)


# ---------------------------------------------------------- fold-wise fits ---

def cross_predict(df: DataFrame, estimator, fold: str, prediction: str = "prediction", path: str | None = None,
                  width: int = WIDTH, fit=None, columns=None) -> DataFrame:
    """M6 + C1: for every fold id, fit on the other folds and predict the fold; ``width`` folds at a time, and
    with ``path`` a run goes on where an earlier one ended (see ``operators.search``).  The input should be
    materialised by the caller (it is read once per fold).  ``fit``: another way to fit on the other folds
    (``cells.Fits``); ``columns``: what to keep beside the prediction (default: all)."""
    return predict_folds(df, estimator, fold, prediction, path, width, fit, columns)


def logo_linear(df: DataFrame, features, label: str, group: str, prediction: str = "prediction") -> DataFrame:
    """L1 under leave-one-group-out, exactly, in one pass over the data.

    Each group's rows [1 X y] become one triangle where they lie (``operators.qr``); a tree over the
    groups gives each the triangle of all other groups, from which its model is solved (coefficients of least
    norm where predictors are dependent, 0 without other rows).  The coefficients are joined back null-safely and
    applied as a native dot product.  Replaces #groups full refits.  NULL predictors count as 0.
    """
    feats = list(features)
    k = len(feats) + 1
    xs = [F.lit(1.0)] + [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in feats]
    y = col(label).cast("double")
    factors = cut_lineage(group_factors(df.where(y.isNotNull()), col(group), [*xs, y]))
    numbered, n = number_rows(factors, ["grp"], "id")
    numbered = cut_lineage(numbered.withColumn("id", F.col("id") - 1))
    rest = without_own(numbered.select("id", "r"), n, k + 1)

    def fit(batches):
        for pdf in batches:
            betas = [solve(np.asarray(r, dtype=float).reshape(-1, k + 1), k).tolist() for r in pdf["r"]]
            yield pd.DataFrame({"id": pdf["id"], "beta": betas})

    betas = rest.mapInPandas(fit, "id long, beta array<double>").join(numbered.select("id", F.col("grp").alias(group)), "id").drop("id")
    j = side_join(df, betas, group, "left")  # one row of coefficients per group
    pred = F.aggregate(F.zip_with("beta", F.array(*xs), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return j.withColumn(prediction, pred).drop("beta")


# ------------------------------------------------------------------ search ---

def regression_evaluator(label: str, metric: str = "mae", prediction: str = "prediction"):
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=metric)


def f1_evaluator(label: str, prediction: str = "prediction"):
    """F1 of the positive class (scikit-learn ``scoring='f1'``), not the
    class-weighted F1 MLlib calls 'f1'."""
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction,
                                             metricName="fMeasureByLabel", metricLabel=1.0)


def param_maps(estimator, grid: dict):
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def _with_folds(df: DataFrame, fold: str | None, num_folds: int, seed: int) -> tuple[DataFrame, str]:
    """The given fold-id column, or seeded random folds written once."""
    if fold:
        return df, fold
    return materialize(df.withColumn("_fold", F.floor(F.rand(seed) * num_folds).cast("int"))), "_fold"


def grid_search(df: DataFrame, estimator, grid: dict, evaluator, fold: str | None = None,
                num_folds: int = 3, parallelism: int = WIDTH, seed: int = 42, path: str | None = None, fit=None) -> Search:
    """H1: exhaustive search scored by cross-validation on a given fold column
    (e.g. contiguous blocks from ``split.fold_id``) or random folds.  ``parallelism`` fits run at a time; with
    ``path`` finished scores are kept there and skipped by a later run.  ``fit``: another way to fit on the other
    folds (``cells.Fits``)."""
    df, fold = _with_folds(df, fold, num_folds, seed)
    return Search(df, estimator, param_maps(estimator, grid), evaluator, fold, path, parallelism, fit)


def random_search(df: DataFrame, estimator, grid: dict, evaluator, fold: str | None = None, n_iter: int = 20,
                  seed: int = 42, num_folds: int = 3, parallelism: int = WIDTH, path: str | None = None) -> Search:
    """H2: ``n_iter`` parameter maps drawn without replacement (seeded) from the
    full grid, then cross-validated like H1."""
    maps = param_maps(estimator, grid)
    chosen = random.Random(seed).sample(maps, min(n_iter, len(maps)))
    df, fold = _with_folds(df, fold, num_folds, seed)
    return Search(df, estimator, chosen, evaluator, fold, path, parallelism)


def cv_table(search: Search, grid_keys=None):
    """Average metric of each candidate as rows (param values as text)."""
    return [(map_text(pm), float(m)) for pm, m in zip(search.getEstimatorParamMaps(), search.avgMetrics, strict=True)]


# -------------------------------------------------------- feature selection ---

def _fit_sliced(assembled: DataFrame, idx, est_factory, label):
    sl = VectorSlicer(inputCol=FEATURES, outputCol="_sel", indices=list(idx)).transform(assembled)
    return est_factory(label, "_sel").fit(sl), sl


def rfe_path(assembled: DataFrame, features, label: str, keep: int, step: int = 1,
             est_factory=None, eval_df: DataFrame | None = None, metric: str = "mae", done=(), record=None):
    """Recursive elimination: fit, drop the ``step`` least important features
    (impurity importance), repeat down to ``keep``.  Returns the surviving
    feature lists at every size and, if ``eval_df`` is given, its metric.

    ``record`` is called with each step's (features, score, features of the next step) as it ends;
    ``done`` has the steps of an earlier run, which aren't fitted again."""
    est_factory = est_factory or (lambda lbl, fcol: forest(lbl, fcol, numTrees=20, maxDepth=8))
    feats = list(features)
    path = [(list(f), s) for f, s, _ in done]
    left = list(done[-1][2]) if done else feats
    while not path or len(path[-1][0]) > keep:
        idx = [feats.index(f) for f in left]
        model, _ = _fit_sliced(assembled, idx, est_factory, label)
        score = None
        if eval_df is not None:
            ev = VectorSlicer(inputCol=FEATURES, outputCol="_sel", indices=idx).transform(eval_df)
            score = float(regression_evaluator(label, metric).evaluate(model.transform(ev)))
        path.append((left, score))
        imp = model.featureImportances.toArray()
        order = sorted(range(len(idx)), key=lambda i: (imp[i], -i))
        drop = set(order[:min(step, max(0, len(idx) - keep))])
        following = [f for i, f in enumerate(left) if i not in drop]
        if record:
            record((left, score, following))
        left = following
    return path


def rfe(df: DataFrame, features, label: str, keep: int = 30, step: int = 1, est_factory=None):
    """FS1: the features kept by recursive elimination (assembled once,
    cut with ``VectorSlicer`` at every step)."""
    a = assemble(materialize(df), features)  # every elimination step re-reads it
    return rfe_path(a, features, label, keep, step, est_factory)[-1][0]


def rfecv(df: DataFrame, features, label: str, fold: str, step: int = 1, min_keep: int = 1,
          est_factory=None, metric: str = "mae", path: str | None = None, width: int = WIDTH):
    """FS2: run elimination inside every fold, score each size on the held-out
    fold, pick the size with the lowest mean error, then eliminate on all
    rows down to that size.  Returns (chosen features, {size: mean score}).

    The folds' eliminations run side by side; each step is kept in a ledger (at ``path``), from which a later
    run goes on."""
    a = assemble(materialize(df), features)  # every fold and step re-reads it
    spark = df.sparkSession
    ledger = Ledger(spark, path)
    kept = ledger.done()
    folds = sorted(r[0] for r in a.select(fold).distinct().collect())  # one value a fold

    def one(name, train, held, least):
        done = sorted((v for k, v in kept.items() if k.startswith(f"{name}/")), key=lambda v: -len(v[0]))
        return rfe_path(train, features, label, least, step, est_factory, eval_df=held, metric=metric, done=done,
                        record=lambda v: ledger.add(f"{name}/{len(v[0])}", v))

    paths = side_by_side(spark, [lambda k=k: one(f"fold {k}", a.where(F.col(fold) != k), a.where(F.col(fold) == k), min_keep)
                                 for k in folds], width)
    scores: dict[int, list[float]] = {}
    for fold_path in paths:
        for feats, s in fold_path:
            scores.setdefault(len(feats), []).append(s)
    mean = {n: float(np.mean(v)) for n, v in scores.items() if len(v) == len(folds)}
    best = min(mean, key=lambda n: (mean[n], n))
    return one(f"all to {best}", a, None, best)[-1][0], mean
