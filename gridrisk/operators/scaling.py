"""Per-group standardisation of a target.

Statistics come from one grouped aggregate (partial aggregation, so a group
holding a third of the rows costs one partial row per task) and are joined
back with a size-checked broadcast; no window is partitioned by the group.
Population standard deviation, zero (or undefined) deviation treated as 1 -
not MLlib ``StandardScaler``, which divides by the sample deviation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..functions.moments import moments, scale_of, without
from ..session import cut_lineage
from .joins import side_join

def fit_scaler(df: DataFrame, key: str, c: str) -> DataFrame:
    """Per-group (mean, scale) of ``c``; scale = population std, 0 -> 1."""
    std = F.stddev_pop(col(c).cast("double"))
    stats = df.groupBy(col(key)).agg(
        F.avg(col(c).cast("double")).alias("mean"),
        F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(std).alias("scale"))
    return cut_lineage(stats)  # one row per group, reused by scale and inverse-scale


def fit_global(df: DataFrame, c: str) -> DataFrame:
    """The fallback statistics over all rows (one row)."""
    std = F.stddev_pop(col(c).cast("double"))
    return cut_lineage(df.agg(F.avg(col(c).cast("double")).alias("g_mean"),
                              F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(std).alias("g_scale")))


def _with_stats(df: DataFrame, stats: DataFrame, key: str, global_stats: DataFrame | None) -> DataFrame:
    out = side_join(df, stats, key, "left", materialize=False)  # fit_scaler output is a checkpoint
    if global_stats is not None:
        out = out.crossJoin(F.broadcast(global_stats))  # one row
        out = out.withColumns({"mean": F.coalesce("mean", "g_mean"), "scale": F.coalesce("scale", "g_scale")})
        out = out.drop("g_mean", "g_scale")
    return out


def standardize(df: DataFrame, key: str, c: str, out: str = "scaled", stats: DataFrame | None = None,
                global_stats: DataFrame | None = None) -> DataFrame:
    """``(x - mean_g) / scale_g``; statistics fitted on ``df`` unless given
    (e.g. fitted on training rows only), unseen groups use ``global_stats``."""
    st = stats if stats is not None else fit_scaler(df, key, c)
    j = _with_stats(df, st, key, global_stats)
    return j.withColumn(out, (col(c).cast("double") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def unstandardize(df: DataFrame, stats: DataFrame, key: str, c: str, out: str | None = None,
                  global_stats: DataFrame | None = None) -> DataFrame:
    """W2 (+W3): ``z * scale_g + mean_g`` with the group's statistics, the global
    ones for a group the statistics don't know."""
    j = _with_stats(df, stats, key, global_stats)
    return j.withColumn(out or c, col(c) * F.col("scale") + F.col("mean")).drop("mean", "scale")


def fit_out_of_fold(df: DataFrame, fold: str, c: str) -> DataFrame:
    """W3 for cross-validation: per fold id, (mean, scale) of ``c`` over all rows
    *outside* that fold: the folds' moments (one grouped aggregate, one row per
    fold), all of them merged, and each fold's taken out again.
    Used to inverse-scale a held-out group without its own (unknown) statistics."""
    per = cut_lineage(df.groupBy(col(fold)).agg(moments(c).alias("_oof_m")))  # one row a fold, read twice
    n = F.sum("_oof_m.n")
    whole = per.agg(n.alias("n"), F.try_divide(F.sum(F.col("_oof_m.n") * F.col("_oof_m.mean")), n).alias("mean"))
    off = F.col("_oof_m.mean") - F.col("_oof_t.mean")
    spread = per.crossJoin(F.broadcast(whole.select(F.struct("n", "mean").alias("_oof_t"))))  # one row
    m2 = spread.agg(F.coalesce(F.sum(F.col("_oof_m.m2") + F.coalesce(F.col("_oof_m.n") * off * off, F.lit(0.0))), F.lit(0.0)).alias("m2"))
    whole = whole.crossJoin(m2).select(F.struct("n", "mean", "m2").alias("_oof_t"))  # one row each
    rest = without(F.col("_oof_t"), F.col("_oof_m"))
    out = per.crossJoin(F.broadcast(whole)).withColumn("_oof_r", rest)
    return cut_lineage(out.select(col(fold), F.col("_oof_r.mean").alias("mean"), scale_of(F.col("_oof_r")).alias("scale")))
