"""Statistics: bounds, histogram, box statistics, correlation, confusion
matrix, OLS with inference and variance inflation (A9, A11-A14, Q1, Q2).

Only k x k triangles and one-row aggregates reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..session import cut_lineage
from .joins import side_join
from .qr import r_factor, rank_of, solve, t_pvalue
from .ranking import row_number_global, running_total


def shared_bounds(df: DataFrame, a: str, b: str) -> DataFrame:
    """One colour scale for two columns: min/max over both, NULLs skipped."""
    return df.agg(F.min(F.least(col(a), col(b))).alias("vmin"),
                  F.max(F.greatest(col(a), col(b))).alias("vmax"))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max (NumPy rules: last bin closed;
    a constant column spans value +- 0.5); empty bins are listed with 0.

    Two aggregate passes (bounds, then counts per bin); the bin frame is
    ``bins`` rows, so it is broadcast.
    """
    spark = df.sparkSession
    x = col(c).cast("double")
    vals = df.select(x.alias("_h_x")).where(F.col("_h_x").isNotNull())
    bounds = vals.agg(F.min("_h_x").alias("_h_min"), F.max("_h_x").alias("_h_max"))
    bounds = bounds.select(
        F.when(F.col("_h_min") == F.col("_h_max"), F.col("_h_min") - 0.5).otherwise(F.col("_h_min")).alias("lo"),
        F.when(F.col("_h_min") == F.col("_h_max"), F.col("_h_max") + 0.5).otherwise(F.col("_h_max")).alias("hi"))
    b = F.least(F.width_bucket(F.col("_h_x"), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins)).cast("int")
    counts = (vals.crossJoin(F.broadcast(bounds))  # one row
                  .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(bounds))
    width = (F.col("hi") - F.col("lo")) / bins
    return (frame.join(F.broadcast(counts), "bin", "left")
                 .select("bin",
                         (F.col("lo") + (F.col("bin") - 1) * width).alias("edge_lo"),
                         (F.col("lo") + F.col("bin") * width).alias("edge_hi"),
                         F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def box_stats(df: DataFrame, key: str, c: str, whisker: float = 1.5, approx: bool = False,
              accuracy: int = 10000) -> DataFrame:
    """Per group: n, quartiles (linear interpolation), IQR, whiskers at the
    furthest value inside 1.5 IQR of the box, outlier count, and a 1..n label
    in key order.  A NULL key is a group of its own.

    Everything is read from a table with one row per (group, value) and its
    count: ties collapse in the map-side aggregate, (group, value) is a unique
    order, so neither a hot group nor a hot value meets in one task.  Positions
    are running sums of the counts in that order.  ``approx=True`` takes the
    quartiles from the mergeable ``percentile_approx`` sketch instead.
    """
    x = col(c).cast("double")
    vals = df.select(col(key).alias(key), x.alias("_bx_x")).where(F.col("_bx_x").isNotNull())
    counted = vals.groupBy(key, "_bx_x").agg(F.count(F.lit(1)).alias("_bx_m"))
    names, qs = ("q1", "median", "q3"), (0.25, 0.5, 0.75)
    if approx:
        counted = cut_lineage(counted)
        quart = vals.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_bx_x", list(qs), accuracy).alias("_bx_q"))
        quart = quart.select(key, "n", *[F.col("_bx_q")[i].alias(nm) for i, nm in enumerate(names)])
    else:
        counted = running_total(counted, [key, "_bx_x"], "_bx_m", "_bx_at")
        groups = counted.groupBy(key).agg(F.sum("_bx_m").alias("n"), F.min("_bx_at").alias("_bx_first"))
        placed = side_join(counted, groups, key, "inner", materialize=False)
        at = F.col("_bx_at") - F.col("_bx_first")
        aggs = [F.first("n").alias("n")]
        for i, q in enumerate(qs):
            for side, r in (("lo", F.floor(F.lit(q) * (F.col("n") - 1))), ("hi", F.ceil(F.lit(q) * (F.col("n") - 1)))):
                aggs.append(F.max(F.when((at <= r) & (r < at + F.col("_bx_m")), F.col("_bx_x"))).alias(f"_{side}{i}"))
        quart = placed.groupBy(key).agg(*aggs)

        def between(i, q):
            part = F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
            return F.col(f"_lo{i}") + part * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))

        quart = quart.select(key, "n", *[between(i, q).alias(nm) for i, (q, nm) in enumerate(zip(qs, names, strict=True))])
    quart = cut_lineage(quart.withColumn("iqr", F.col("q3") - F.col("q1")))  # one row per group, used twice
    fenced = side_join(counted, quart.select(key, "q1", "q3", "iqr"), key, "inner", materialize=False)
    lo_f = F.col("q1") - whisker * F.col("iqr")
    hi_f = F.col("q3") + whisker * F.col("iqr")
    out_of = (F.col("_bx_x") < lo_f) | (F.col("_bx_x") > hi_f)
    whisk = fenced.groupBy(key).agg(
        F.min(F.when(F.col("_bx_x") >= lo_f, F.col("_bx_x"))).alias("whisker_low"),
        F.max(F.when(F.col("_bx_x") <= hi_f, F.col("_bx_x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(out_of, F.col("_bx_m"))), F.lit(0)).alias("n_outliers"))
    out = side_join(quart, whisk, key, "inner", materialize=False)
    return row_number_global(out, [key], "label")


def pearson(df: DataFrame, pairs) -> DataFrame:
    """Pearson r for each (a, b) pair, one aggregate pass; column ``r_<a>_<b>``."""
    return df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"r_{a}_{b}") for a, b in pairs])


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts of every (label, prediction) over the classes that occur, 0 and 1 at least;
    empty cells 0.  A NULL or fractional class raises."""
    def whole(c):
        v = col(c).cast("double")
        bad = v.isNull() | (v != F.floor(v))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"confusion: {c} is no class: "), F.coalesce(col(c).cast("string"), F.lit("NULL"))))
                      ).otherwise(v.cast("int"))

    counts = cut_lineage(df.groupBy(whole(label).alias("label"), whole(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n")))
    classes = (counts.select(F.explode(F.array("label", "prediction")).alias("c"))
                     .unionByName(df.sparkSession.range(2).select(F.col("id").cast("int").alias("c"))).distinct())
    cells = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))  # the matrix itself
    return (cells.join(counts, ["label", "prediction"], "left")
                 .select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n")))


def ols_one(df: DataFrame, y: str, x: str) -> DataFrame:
    """Q1 with one predictor, closed form in one aggregate: coefficients,
    standard errors, t values, R^2 and adjusted R^2 (intercept included)."""
    a = df.select(col(y).cast("double").alias("_y"), col(x).cast("double").alias("_x"))
    s = a.agg(F.regr_count("_y", "_x").alias("n"), F.regr_slope("_y", "_x").alias("slope"),
              F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"),
              F.regr_sxx("_y", "_x").alias("sxx"), F.regr_sxy("_y", "_x").alias("sxy"),
              F.regr_syy("_y", "_x").alias("syy"), F.regr_avgx("_y", "_x").alias("xbar"))
    # try_divide: fewer than 3 rows or a constant predictor give NULL, not an error
    dof = (F.col("n") - 2).cast("double")
    sigma2 = F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), dof)
    se_slope = F.sqrt(F.try_divide(sigma2, F.col("sxx")))
    se_int = F.sqrt(sigma2 * (F.try_divide(F.lit(1.0), F.col("n").cast("double"))
                              + F.try_divide(F.col("xbar") * F.col("xbar"), F.col("sxx"))))
    adj = F.lit(1.0) - F.try_divide((F.lit(1.0) - F.col("r2")) * (F.col("n") - 1), dof)
    return s.select(
        F.col("n"), F.col("r2"), adj.alias("r2_adj"),
        F.col("intercept"), se_int.alias("se_intercept"), F.try_divide(F.col("intercept"), se_int).alias("t_intercept"),
        F.col("slope"), se_slope.alias("se_slope"), F.try_divide(F.col("slope"), se_slope).alias("t_slope"))


def ols(df: DataFrame, y: str, xs, fill_zero: bool = True) -> DataFrame:
    """Q1: OLS with an intercept and inference from the triangle of [1, X, y] (``operators.qr``): one row
    per term with coefficient, standard error, t and p values, plus R^2 and adjusted R^2.  NULL
    predictors become 0 as in the reference (else their rows are left out); rows with a NULL ``y`` are left out.

    Dependent predictors get the coefficients of least norm, and with them or without a degree of freedom
    the inference is NULL; R^2 of a constant ``y`` and adjusted R^2 without a degree of freedom are NULL."""
    xs = list(xs)
    columns = [F.lit(1.0), *[F.coalesce(col(c).cast("double"), F.lit(0.0)) if fill_zero else col(c).cast("double") for c in xs]]
    a = df.where(col(y).isNotNull())
    if not fill_zero:
        a = a.na.drop(subset=xs)
    r, n = r_factor(a, [*columns, col(y).cast("double")])
    k = len(xs) + 1
    spark = df.sparkSession
    schema = "term string, coef double, std_err double, t double, p_value double, r2 double, r2_adj double, n long"
    if not n:
        return spark.createDataFrame([(t, None, None, None, None, None, None, 0) for t in [*xs, "const"]], schema)
    r = np.concatenate([r, np.zeros((k + 1 - len(r), k + 1))])
    beta = solve(r, k)
    rss = float(((r[:, k] - r[:, :k] @ beta) ** 2).sum())
    sst = float((r[1:, k] ** 2).sum())  # what the first column, the constant, leaves of y
    dof, rank = n - k, rank_of(r[:, :k], n)
    flat = sst <= (n * np.finfo(float).eps * abs(r[0, k])) ** 2
    r2 = None if flat else 1 - rss / sst
    adj = None if flat or dof <= 0 else 1 - (rss / dof) / (sst / (n - 1))
    errors = [None] * k
    if rank == k and dof > 0:
        inv = np.linalg.inv(r[:k, :k])
        errors = [float(e) for e in np.sqrt(rss / dof * (inv ** 2).sum(axis=1))]
    rows = []
    for i in [*range(1, k), 0]:
        t = float(beta[i] / errors[i]) if errors[i] else None
        rows.append((xs[i - 1] if i else "const", float(beta[i]), errors[i], t, t_pvalue(t, dof) if t is not None else None, r2, adj, n))
    return spark.createDataFrame(rows, schema)


def gram(df: DataFrame, xs) -> np.ndarray:
    """X'X of the given columns (NULL -> 0), from their triangle."""
    r, _ = r_factor(df, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in xs])
    return r.T @ r


def vif(df: DataFrame, xs) -> DataFrame:
    """Q2: variance inflation factor of each predictor against the others
    *without* an intercept (uncentred R^2), from the triangle R of X (NULL -> 0):
    VIF_i = |X_i|^2 times the squared length of row i of R^-1.  Dependent predictors (and all-zero ones) have
    the pseudo-inverse's value.  Sorted descending."""
    xs = list(xs)
    r, n = r_factor(df, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in xs])
    r = np.concatenate([r, np.zeros((len(xs) - len(r), len(xs)))])
    lengths = np.linalg.norm(r, axis=0)
    scaled = r / np.where(lengths > 0, lengths, 1.0)  # predictors of equal length
    inv = np.linalg.inv(scaled) if n and rank_of(r, n) == len(xs) else np.linalg.pinv(scaled)
    vals = [(c, float((inv[i] ** 2).sum())) for i, c in enumerate(xs)]
    vals.sort(key=lambda v: -v[1])
    return df.sparkSession.createDataFrame(vals, "feature string, vif double")
