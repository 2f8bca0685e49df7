"""A fitted forest as a table of nodes, and what can be read from it without the rows.

MLlib writes a model's nodes as a table.  ``node_table`` reads that table back under plain column names;
importances are grouped sums over it.  Partial dependence walks each tree once: a walk gives every leaf the
interval of the target feature that leads to it and the share of training rows that the other splits
send there, so the mean prediction at any value is a sum over leaves.  A tree is one group; its size
depends on the model's depth, never on the data.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def node_table(spark, model, path: str | None = None) -> DataFrame:
    """One row per node: tree, weight (its prediction's weight in the ensemble's sum), node, prediction, impurity, n
    (training rows, as often as drawn), gain, left, right (children; -1: leaf), feature (index; -1: leaf),
    threshold (values up to it go left; NULL: leaf or categorical split).

    The model is written to ``path`` (default: a folder of its own in the checkpoint folder) and read from there."""
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:  # a single tree's nodes stand at the top
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct(*nodes.columns).alias("nodeData"))
    boosted = "GBT" in type(model).__name__
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if not boosted:
        weights = [1.0 / len(weights)] * len(weights)
    d, continuous = "nodeData", F.col("nodeData.split.numCategories") == -1
    return nodes.select(
        F.col("treeID").alias("tree"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("treeID") + 1).alias("weight"),
        F.col(f"{d}.id").alias("node"), f"{d}.prediction", f"{d}.impurity", F.col(f"{d}.rawCount").alias("n"), f"{d}.gain",
        F.col(f"{d}.leftChild").alias("left"), F.col(f"{d}.rightChild").alias("right"), F.col(f"{d}.split.featureIndex").alias("feature"),
        F.when(continuous & (F.col(f"{d}.leftChild") >= 0), F.get(F.col(f"{d}.split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"))


def node_importance(nodes: DataFrame, features) -> DataFrame:
    """X1 from the node table: a split's gain times its rows, as shares of each tree, averaged over trees that
    split and scaled to sum 1; features that no tree uses have 0.  Ranked, ties in the order of ``features``."""
    splits = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    trees = splits.groupBy("tree").agg(F.sum("g").alias("t"))
    share = splits.join(trees, "tree").groupBy("feature").agg(F.sum(F.try_divide("g", "t")).alias("s"))
    total = share.agg(F.sum("s").alias("total"))  # one row
    names = nodes.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "feature int, name string")
    out = names.join(share, "feature", "left").crossJoin(F.broadcast(total))
    imp = F.coalesce(F.try_divide("s", "total"), F.lit(0.0))
    ranked = out.select(F.col("name"), imp.alias("importance"), F.col("feature").alias("i"))
    order = F.row_number().over(_order())  # one row per feature
    return ranked.select(F.col("name").alias("feature"), "importance", order.cast("int").alias("rank"))


def _order():
    from pyspark.sql import Window
    return Window.orderBy(F.desc("importance"), "i")


def leaf_boxes(nodes: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(feature, lo, hi, value): summed over all leaves that lo < x <= hi reaches, the share that the other
    splits send there times prediction and tree weight.  Thresholds are few (``maxBins``), and so are the rows."""
    index = {features.index(t): t for t in targets}

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        t = tree.sort_values("node").set_index("node")
        n, left, right = t["n"].to_numpy(float), t["left"].to_numpy(), t["right"].to_numpy()
        at = pd.Series(np.arange(len(t)), index=t.index)
        feature, threshold = t["feature"].to_numpy(), t["threshold"].to_numpy(float)
        value = t["prediction"].to_numpy() * t["weight"].to_numpy()
        out = []
        for i, name in index.items():
            share, lo, hi = np.zeros(len(t)), np.full(len(t), -np.inf), np.full(len(t), np.inf)
            share[0] = 1.0
            level = np.array([0])
            while len(level):
                level = level[left[level] >= 0]
                on = feature[level] == i
                if np.isnan(threshold[level[on]]).any():
                    raise ValueError(f"{name}: categorical splits have no partial dependence by intervals")
                kids = []
                for child, closed in ((left, True), (right, False)):
                    c = at[child[level]].to_numpy() if len(level) else np.array([], dtype=int)
                    share[c] = share[level] * np.where(on, 1.0, n[c] / n[level])
                    cut = threshold[level]
                    lo[c] = np.where(on & (not closed), np.fmax(lo[level], cut), lo[level])
                    hi[c] = np.where(on & closed, np.fmin(hi[level], cut), hi[level])
                    kids.append(c)
                level = np.concatenate(kids)
            leaf = left < 0
            out.append(pd.DataFrame({"feature": name, "lo": lo[leaf], "hi": hi[leaf], "value": share[leaf] * value[leaf]}))
        return pd.concat(out)

    each = nodes.groupBy("tree").applyInPandas(walk, "feature string, lo double, hi double, value double")
    return each.where("lo < hi").groupBy("feature", "lo", "hi").agg(F.sum("value").alias("value"))


def dependence(boxes: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Mean prediction at each value of the grids: (feature, value, mean_prediction)."""
    points = F.create_map(*[x for t, vs in grid.items() for x in (F.lit(t), F.array(*[F.lit(float(v)) for v in vs]).cast("array<double>"))])
    met = boxes.withColumnRenamed("value", "part").withColumn("value", F.explode(points[F.col("feature")]))
    met = met.where((F.col("lo") < F.col("value")) & (F.col("value") <= F.col("hi")))
    return met.groupBy("feature", "value").agg(F.sum("part").alias("mean_prediction"))
