"""Joins (J1-J7) and the null-safe side-table join they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def side_join(big: DataFrame, side: DataFrame, on, how: str = "left", materialize: bool = True) -> DataFrame:
    """Join a per-key side table (group statistics, fold ids, ...) on its key, NULL
    keys included: grouping keeps a NULL group, so its statistics must find
    their rows again.

    The side table is materialised once in the checkpoint folder
    (``materialize=False`` when it is cheap to re-read).  How the join runs is
    left to the planner: AQE broadcasts a side table that turns out small in
    bytes and splits skewed keys otherwise.
    """
    if materialize:
        side = cut_lineage(side)
    keys = [on] if isinstance(on, str) else list(on)
    # fresh names and attribute ids: a side table derived from (or checkpointed
    # from) the big side's lineage would otherwise be an ambiguous self-join
    names = {k: f"_sj_{i}" for i, k in enumerate(keys)}
    side = side.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in side.columns])
    match = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()])
    return big.join(side, match, how).drop(*names.values())


def attach(left: DataFrame, right: DataFrame, on, how: str = "left", fill=None) -> DataFrame:
    """Keyed left join, optionally filling the right side's NULLs."""
    out = left.join(right, on, how)
    if fill is not None:
        added = [c for c in right.columns if c not in (on if isinstance(on, (list, tuple)) else [on])]
        out = out.na.fill(fill, subset=added)
    return out


def risk_join(dfs, on) -> DataFrame:
    """Inner join of several per-key aggregates.

    When the inputs are aggregates on the same key, Spark plans one exchange
    per input and the joins reuse that partitioning: no extra shuffle.
    """
    return reduce(lambda a, b: a.join(b, on, "inner"), dfs)


def attach_geometry(geo: DataFrame, metrics: DataFrame, on: str = "grid", fill=0) -> DataFrame:
    """Every geometry row kept; metrics of missing cells become ``fill``."""
    out = geo.join(metrics, on, "left")
    added = [c for c in metrics.columns if c != on]
    return out.na.fill(fill, subset=added) if fill is not None else out


def write_back(panel: DataFrame, preds: DataFrame, key, pred_col: str) -> DataFrame:
    """Predictions joined back on the panel key; rows outside the test mask stay NULL."""
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    return panel.join(preds.select(*keys, pred_col), keys, "left")


def reorder(df: DataFrame, c: str, keys, name: str = "position") -> DataFrame:
    """The rows of the listed keys, in the list's order, with their 1-based ``name`` in it.

    Rows of other keys are dropped; a listed key that the data lacks raises, as
    a look-up by label does.  The list is the caller's, so its table is
    broadcast."""
    listed = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys, 1)],
                                             f"_ro_key {df.schema[c].dataType.simpleString()}, {name} int")
    found = df.select(F.col(c).alias("_ro_key")).distinct()
    absent = listed.join(found, "_ro_key", "left_anti").agg(F.array_sort(F.collect_list("_ro_key")).alias("k")).first()["k"]
    if absent:
        raise KeyError(f"{c}: listed keys that the data lacks: {absent}")
    return df.join(F.broadcast(listed), F.col(c) == F.col("_ro_key"), "inner").drop("_ro_key").orderBy(name)
