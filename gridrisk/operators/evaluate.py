"""Evaluation (E1-E8), sort/top-k (T1-T3), fold union (C1) and the
deterministic baseline predictor used to check evaluation without ML noise.

All metrics are conditional sums in one aggregate pass per grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, smape_term
from ..session import cut_lineage
from .joins import side_join


def _reg_aggs(y, p, cond: Column | None = None, suffix: str = "") -> list[Column]:
    def w(e):
        return e if cond is None else F.when(cond, e)
    err = col(p).cast("double") - col(y).cast("double")
    yv = col(y).cast("double")
    n = F.count(w(err))
    sse = F.sum(w(err * err))
    sst = F.var_pop(w(yv)) * n
    r2 = (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - sse / sst))
    return [n.alias(f"n{suffix}"),
            F.avg(w(F.abs(err))).alias(f"mae{suffix}"),
            F.sqrt(F.avg(w(err * err))).alias(f"rmse{suffix}"),
            r2.alias(f"r2{suffix}"),
            (F.lit(100.0) * F.avg(w(smape_term(y, p)))).alias(f"smape{suffix}")]


def regression_metrics(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """E1+E2 (and E6 with ``by``): n, MAE, RMSE, R^2 (constant truth: 1 if no
    error else 0), SMAPE (0..200)."""
    g = df.groupBy(*[col(b) for b in by]) if by else df.groupBy()
    return g.agg(*_reg_aggs(y, p))


def nonzero_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """The E1/E2 set over rows with truth above 0, in the same pass as the
    overall set; NULLs (absent) when there are no such rows."""
    nz = col(y) > 0
    return df.agg(*_reg_aggs(y, p), *_reg_aggs(y, p, nz, "_nonzero"))


def smape_by_zero(df: DataFrame, y: str, p: str) -> DataFrame:
    """E5: SMAPE overall, on zero truth and on non-zero truth."""
    t = smape_term(y, p)
    return df.agg((F.lit(100.0) * F.avg(t)).alias("smape_all"),
                  (F.lit(100.0) * F.avg(F.when(col(y) == 0, t))).alias("smape_zero"),
                  (F.lit(100.0) * F.avg(F.when(col(y) != 0, t))).alias("smape_nonzero"))


def threshold_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.0) -> DataFrame:
    """One evaluation table: truth and prediction binarised above a threshold give precision, recall and F1,
    next to the E1/E2 set overall and for truth above 0; everything in one pass."""
    yv, pv = col(y) > threshold, col(p) > threshold
    c = df.agg(F.count_if(yv & pv).alias("tp"), F.count_if(~yv & pv).alias("fp"), F.count_if(yv & ~pv).alias("fn"),
               *_reg_aggs(y, p), *_reg_aggs(y, p, col(y) > 0, "_nonzero"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.withColumns({"precision": precision, "recall": recall, "f1": f1})


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 of the positive class;
    a zero division gives 0."""
    yv, pv = col(y).cast("int"), col(p).cast("int")
    c = df.agg(F.count_if((yv == 1) & (pv == 1)).alias("tp"), F.count_if((yv == 0) & (pv == 1)).alias("fp"),
               F.count_if((yv == 1) & (pv == 0)).alias("fn"), F.count_if((yv == 0) & (pv == 0)).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", "tn",
                    F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).cast("double").alias("precision"),
                    F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).cast("double").alias("recall"),
                    F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).cast("double").alias("f1"))


def pooled_and_mean(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """Pooled SMAPE/MAE over all rows next to the mean of per-group values."""
    per = regression_metrics(df, y, p, by=[key])
    mean = per.agg(F.avg("smape").alias("mean_group_smape"), F.avg("mae").alias("mean_group_mae"),
                   F.count(F.lit(1)).alias("n_groups"))
    pooled = df.agg((F.lit(100.0) * F.avg(smape_term(y, p))).alias("pooled_smape"),
                    F.avg(F.abs(col(p) - col(y))).alias("pooled_mae"))
    return pooled.crossJoin(mean)  # both sides are one row


def leaderboard(df: DataFrame, model: str, y: str, p: str) -> DataFrame:
    """One row per model, sorted by SMAPE (ties by name)."""
    return regression_metrics(df, y, p, by=[model]).orderBy("smape", model)


def sort_by(df: DataFrame, c: str, descending: bool = True, tie=None) -> DataFrame:
    """Sort on a metric with an explicit tie-break key."""
    o = F.desc_nulls_last(c) if descending else F.asc_nulls_last(c)
    return df.orderBy(o, *([F.asc(tie)] if tie else []))


def top_k(df: DataFrame, c: str, k: int, descending: bool = True, tie=None) -> DataFrame:
    """The k best rows (a bounded TakeOrderedAndProject, no full sort)."""
    return sort_by(df, c, descending, tie).limit(k)


def union_folds(*dfs: DataFrame) -> DataFrame:
    """Append per-fold results (UNION ALL by column name)."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def baseline_predict(weekly: DataFrame, *, cell: str, target: str, train, test,
                     week: str = "week", out: str = "predicted", global_out: str | None = None,
                     materialize: bool = True) -> DataFrame:
    """A deterministic predictor for the evaluation chain: the cell's mean
    target over the training weeks, the global training mean for a cell
    without training rows; returned for the test-week rows (with the global
    mean as a second predictor in ``global_out``).  The input is read twice
    (training sums, test rows), so it is materialised once unless
    ``materialize=False``."""
    if materialize:
        weekly = cut_lineage(weekly)
    tr = weekly.where(col(week).between(*train))
    te = weekly.where(col(week).between(*test))
    y = col(target).cast("double")
    per_cell = cut_lineage(tr.groupBy(col(cell)).agg(F.sum(y).alias("_bp_s"), F.count(y).alias("_bp_n")))
    # the global training mean comes from the per-cell sums: no second pass over the input
    glob = per_cell.agg(F.try_divide(F.sum("_bp_s"), F.sum("_bp_n")).alias("_bp_glob"))
    cells = per_cell.select(col(cell), F.try_divide(F.col("_bp_s"), F.col("_bp_n")).alias("_bp_cell"))
    j = side_join(te, cells, cell, "left", materialize=False).crossJoin(F.broadcast(glob))  # glob: one row
    j = j.withColumn(out, F.coalesce("_bp_cell", "_bp_glob"))
    if global_out:
        j = j.withColumn(global_out, F.col("_bp_glob"))
    return j.drop("_bp_cell", "_bp_glob")
