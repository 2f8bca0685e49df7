"""Fold and split assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from .joins import side_join
from .ranking import dense_rank_keys, ntile_global, rank_within, running_total

def _floor_div(a, k: int):
    return ((a - F.pmod(a, F.lit(k))) / k).cast("long")


def fold_id(df: DataFrame, k: int, order_by, label: str | None = None, name: str = "fold") -> DataFrame:
    """Contiguous k-fold id (0..k-1) in row order, first ``n mod k`` folds one
    row larger (scikit-learn ``KFold`` without shuffling).  With ``label``, the
    classifier form (``StratifiedKFold`` without shuffling): the label-sorted
    rows are dealt round-robin into k slices, and each label's rows, in order,
    are cut into contiguous runs as long as the slices hold rows of it.  A NULL
    label is a class of its own, before the others.  ``order_by`` must be
    unique.  Positions and the labels' starts come from distributed numbering;
    nothing reaches the driver."""
    if label is None:
        return ntile_global(df, k, order_by, name)
    r = rank_within(df, [label], order_by, name="_fd_pos")
    classes = r.groupBy(col(label).alias(label)).agg(F.count(F.lit(1)).alias("_fd_n"))
    classes = running_total(classes, [label], "_fd_n", "_fd_start")
    # rows of the class that slices 0..f hold, i.e. where its run in fold f ends
    until = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: (
        _floor_div(F.col("_fd_start") + F.col("_fd_n") - 1 - f, k) - _floor_div(F.col("_fd_start") - 1 - f, k)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(F.slice("_fd_sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    classes = classes.withColumn("_fd_sizes", until).select(label, ends.alias("_fd_ends"))
    j = side_join(r, classes, label, "inner", materialize=False)
    fold = F.size(F.filter("_fd_ends", lambda e: e <= F.col("_fd_pos"))).cast("int")
    return j.withColumn(name, fold).drop("_fd_pos", "_fd_pos_n", "_fd_ends")


def temporal_splits(df: DataFrame, specs, week: str = "week") -> DataFrame:
    """M3: tag rows with (split, role) for every spec whose inclusive week range
    holds them; specs may overlap (a row then appears once per split) or leave
    gaps (rows in no range are dropped).

    ``specs``: list of {"train": (lo, hi), "test": (lo, hi)}, tested row by row
    (no join).
    """
    spans = F.array(*[F.struct(F.lit(i).alias("split"), F.lit(role).alias("role"), F.lit(int(lo)).alias("lo"), F.lit(int(hi)).alias("hi"))
                      for i, s in enumerate(specs, 1) for role, (lo, hi) in s.items()])
    held = F.filter(spans, lambda x: col(week).between(x["lo"], x["hi"]))
    j = df.withColumn("_ts", F.explode(held))
    return j.withColumns({"split": F.col("_ts.split"), "role": F.col("_ts.role")}).drop("_ts")


def cut_split(df: DataFrame, cut: int, week: str = "week") -> DataFrame:
    """M4: 'early' for week <= cut, 'late' after."""
    return df.withColumn("role", F.when(col(week) <= cut, F.lit("early")).otherwise(F.lit("late")))


def logo_folds(df: DataFrame, group: str, name: str = "fold") -> DataFrame:
    """M5: leave-one-group-out fold = dense rank of the group - 1 (0..G-1)."""
    ranks = dense_rank_keys(df, [group], "_lg_rank").select(group, (F.col("_lg_rank") - 1).cast("int").alias(name))
    return side_join(df, ranks, group, "inner", materialize=False)  # ranks read a checkpoint


def group_kfold(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """M5 for many groups: whole groups dealt into k folds by their dense rank (no fold is empty when
    there are at least k groups)."""
    ranked = logo_folds(df, group, name)
    return ranked.withColumn(name, F.pmod(F.col(name), F.lit(k)).cast("int"))
