"""Model explanation.

Permutation importance is built as one DataFrame job: rows are ranked once, a keyed
permutation of the ranks per block and repeat (``functions.permute``) says where a row's values
go, one join brings them there, and the variants are scored by one ``transform`` and one grouped
metric aggregate.  Partial dependence has two forms: over all rows (``partial_dependence``), and by a
weighted walk through the trees alone (``tree_dependence``).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, smape_term
from ..functions.permute import key_column, round_keys, with_image
from .forest import dependence, leaf_boxes
from .ranking import number_rows


def importances(model, features) -> list[tuple[str, float]]:
    """Impurity importances (normalised to sum 1), highest first."""
    imp = model.featureImportances.toArray()
    return sorted(zip(features, map(float, imp)), key=lambda t: (-t[1], t[0]))


def importances_df(spark, model, features) -> DataFrame:
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(importances(model, features))]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def permuted_places(ranked: DataFrame, place, n: int, blocks, n_repeats: int, seed: int) -> DataFrame:
    """Every row once per (block, repeat) with ``_pv_to``, the place that its values go to: a keyed
    pseudo-random permutation of the places 0..n-1, one key for each block and repeat."""
    blocks = list(blocks)
    keys = F.array(*[key_column(round_keys(seed, i)) for i in range(len(blocks) * n_repeats)])  # a literal: rows carry its index
    out = ranked.withColumn("_pv_i", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) * n_repeats - 1)))).withColumn("_pv_at", place)
    out = with_image(out, "_pv_at", n, keys[F.col("_pv_i")], "_pv_to")
    block = F.array(*[F.lit(b) for b in blocks])[F.call_function("div", "_pv_i", F.lit(n_repeats)).cast("int")]
    return out.withColumns({"_pv_block": block, "_pv_rep": F.col("_pv_i") % n_repeats}).drop("_pv_i", "_pv_at")


def permuted_variants(df: DataFrame, key, blocks: dict, n_repeats: int, seed: int) -> DataFrame:
    """Rows of ``df`` once per (block, repeat) with the block's columns taken
    from a seeded permutation of the rows.

    Every row gets its place by ``key`` (unique) once.  It then sends its values of each block to the
    place that the block's permutation names, so only the moved columns are shuffled for each
    variant; the rows themselves are shuffled once and meet their variants in one join.
    """
    base, n = number_rows(df, list(key), "_pv_pos")
    values = None  # the block's columns in its order
    for b, cs in blocks.items():
        own, is_b = F.array(*[col(c).cast("double") for c in cs]), F.col("_pv_block") == b
        values = F.when(is_b, own) if values is None else values.when(is_b, own)
    sent = permuted_places(base, F.col("_pv_pos") - 1, n, blocks, n_repeats, seed)
    sent = sent.select("_pv_block", "_pv_rep", (F.col("_pv_to") + 1).alias("_pv_to"), values.alias("_pv_values"))
    j = base.join(sent, F.col("_pv_pos") == F.col("_pv_to"))
    new = {}
    for c in sorted({c for cs in blocks.values() for c in cs}):
        value = None
        for b, cs in blocks.items():
            if c in cs:
                got, is_b = F.col("_pv_values")[list(cs).index(c)], F.col("_pv_block") == b
                value = F.when(is_b, got) if value is None else value.when(is_b, got)
        new[c] = value.otherwise(col(c))
    return j.withColumns(new).drop("_pv_pos", "_pv_to", "_pv_values")


def _score_aggs(label: str, metric: str):
    y, p = col(label).cast("double"), F.col("prediction").cast("double")
    if metric == "r2":
        sse = F.sum((p - y) * (p - y))
        sst = F.var_pop(y) * F.count(y)
        return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst)
    if metric == "smape":
        return F.lit(100.0) * F.avg(smape_term(label, "prediction"))
    if metric == "f1":
        tp = F.count_if((y == 1) & (p == 1))
        fp = F.count_if((y == 0) & (p == 1))
        fn = F.count_if((y == 1) & (p == 0))
        return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0)).cast("double")
    if metric == "mae":
        return F.avg(F.abs(p - y))
    raise ValueError(metric)


def block_importance(df: DataFrame, model, features, blocks: dict, label: str, key, metric: str = "r2",
                     n_repeats: int = 1, seed: int = 42) -> DataFrame:
    """X3 (and X2 with one-column blocks): score change when a block's columns
    are permuted together.  ``importance`` = baseline - permuted for metrics
    where larger is better (r2, f1), permuted - baseline otherwise (smape,
    mae); mean and std over repeats."""
    feats = list(features)
    asm = VectorAssembler(inputCols=feats, outputCol=model.getFeaturesCol(), handleInvalid="keep")
    base_pred = model.transform(asm.transform(df))
    baseline = base_pred.agg(_score_aggs(label, metric).alias("baseline"))
    var = permuted_variants(df.select(*list(key), label, *feats), key, blocks, n_repeats, seed)
    scored = model.transform(asm.transform(var))
    per = scored.groupBy("_pv_block", "_pv_rep").agg(_score_aggs(label, metric).alias("score"))
    sign = 1.0 if metric in ("r2", "f1") else -1.0
    per = per.crossJoin(F.broadcast(baseline)).withColumn("drop", F.lit(sign) * (F.col("baseline") - F.col("score")))
    return (per.groupBy(F.col("_pv_block").alias("block"))
               .agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std"),
                    F.first("baseline").alias("baseline"))
               .orderBy(F.desc("importance"), "block"))


def permutation_importance(df: DataFrame, model, features, label: str, key, n_repeats: int = 10,
                           seed: int = 42, metric: str = "r2") -> DataFrame:
    """Mean drop of R^2 over ``n_repeats`` seeded permutations per feature."""
    out = block_importance(df, model, features, {f: [f] for f in features}, label, key, metric, n_repeats, seed)
    return out.withColumnRenamed("block", "feature")


def dependence_grid(df: DataFrame, targets, points: int = 100, lo: float = 0.05, hi: float = 0.95,
                    accuracy: int = 10000) -> dict[str, list[float]]:
    """X4's grids: the values of a feature that has fewer than ``points``, else ``points`` values spread
    evenly between its 5th and 95th percentiles."""
    x = {t: col(t).cast("double") for t in targets}
    q = df.agg(*[F.percentile_approx(x[t], [lo, hi], accuracy).alias(f"q_{t}") for t in targets],
               *[F.approx_count_distinct(x[t]).alias(f"n_{t}") for t in targets]).first()
    grid = {}
    for t in targets:
        values = None
        if q[f"n_{t}"] < 2 * points:  # a sketch's count: the exact values decide
            values = sorted(r[0] for r in df.select(x[t]).where(x[t].isNotNull()).distinct().limit(points).collect())
        if values is None or len(values) >= points:
            values = np.linspace(*q[f"q_{t}"], points) if q[f"q_{t}"] else []
        grid[t] = [float(v) for v in values]
    return grid


def partial_dependence(df: DataFrame, model, features, targets, points: int = 100,
                       lo: float = 0.05, hi: float = 0.95, accuracy: int = 10000) -> DataFrame:
    """Mean prediction when one feature is set to each value of its grid, over
    *all* rows.  A feature with fewer than ``points`` values has them as its grid
    (a flag is only ever 0 or 1), others ``points`` values spread evenly between
    their 5th and 95th percentiles.

    Every row meets every grid value (that is the definition), in one
    ``transform`` and one grouped average, a narrow step: the grid, at most
    ``points`` values per target feature, is an array that rows explode.
    Percentiles use the mergeable ``percentile_approx``.
    """
    feats = list(features)
    grid = [F.struct(F.lit(t).alias("feature"), F.lit(v).alias("value"))
            for t, vs in dependence_grid(df, targets, points, lo, hi, accuracy).items() for v in vs]
    rows = df.select(*feats).withColumn("_pd", F.explode(F.array(*grid)))
    rows = rows.withColumns({t: F.when(F.col("_pd.feature") == t, F.col("_pd.value")).otherwise(col(t)) for t in targets})
    asm = VectorAssembler(inputCols=feats, outputCol=model.getFeaturesCol(), handleInvalid="keep")
    pred = model.transform(asm.transform(rows))
    return (pred.groupBy(F.col("_pd.feature").alias("feature"), F.col("_pd.value").alias("value"))
                .agg(F.avg("prediction").alias("mean_prediction"))
                .orderBy("feature", "value"))


def tree_dependence(nodes: DataFrame, features, grid: dict[str, list[float]]) -> DataFrame:
    """X4 by the trees alone, the form that tree-recursion takes for a forest: where a tree splits on the
    feature the grid value decides, at every other split both sides are taken with the shares of their
    training rows.  Reads the node table (``forest.node_table``) and no rows; ``grid`` as from
    ``dependence_grid``.  Columns as ``partial_dependence``."""
    return dependence(leaf_boxes(nodes, list(features), list(grid)), grid).orderBy("feature", "value")


def group_importance(imp: DataFrame, mapping: DataFrame, feature: str = "feature",
                     value: str = "importance") -> DataFrame:
    """Importances summed per feature group (features without a group
    fall in 'other')."""
    j = imp.join(F.broadcast(mapping), feature, "left")  # mapping: one row per feature name
    return (j.groupBy(F.coalesce(F.col("group"), F.lit("other")).alias("group"))
             .agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n_features"))
             .orderBy(F.desc(value), "group"))
