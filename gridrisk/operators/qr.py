"""Tall-skinny QR: triangular factors of a frame's columns, made where rows lie and combined in a tree.

The R factor of rows A and rows B together is the R factor of their two R factors, so each partition keeps
one k x k triangle and triangles are combined in groups.  Least squares read from R never form X'X, whose
condition number is the square of X's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Triangles that one task combines, and groups that a partition holds before it hands its triangles on.
FAN = 32
HELD = 1000


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, with a non-negative diagonal (so that it is the same for any order of combining)."""
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]


def combined(parts: list, k: int) -> np.ndarray:
    stacked = np.concatenate([np.asarray(p, dtype=float).reshape(-1, k) for p in parts]) if len(parts) else np.zeros((0, k))
    return triangle(stacked) if len(stacked) else stacked


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)])


def r_factor(df: DataFrame, columns: list[Column]) -> tuple[np.ndarray, int]:
    """R (at most k x k) and the number of rows of the given columns, which must have no NULL."""
    ship(df.sparkSession)
    k = len(columns)
    data = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, k)), 0
        for batch in batches:
            if batch.num_rows:
                r, n = triangle(np.concatenate([r, _matrix(batch, 0)])), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "r"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "part": [int(pdf["part"].iloc[0]) // FAN], "r": [combined(list(pdf["r"]), k).ravel().tolist()]})

    parts = data.mapInArrow(local, "n long, r array<double>").withColumn("part", F.spark_partition_id().cast("long"))
    parts = parts.groupBy(F.call_function("div", "part", F.lit(FAN))).applyInPandas(join, "n long, part long, r array<double>")
    parts = parts.groupBy(F.pmod("part", F.lit(FAN))).applyInPandas(join, "n long, part long, r array<double>")
    rows = parts.select("n", "r").collect()  # at most FAN triangles
    return combined([x["r"] for x in rows], k), sum(x["n"] for x in rows)


def group_factors(df: DataFrame, group: Column, columns: list[Column]) -> DataFrame:
    """(grp, r): one triangle per group (a NULL group is one of its own), of columns without NULLs.

    A partition keeps a triangle for each of up to ``HELD`` groups; a group of any size meets as triangles only."""
    ship(df.sparkSession)
    k = len(columns)
    data = df.select(group.alias("grp"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    kind = data.schema["grp"].dataType.simpleString()
    arrow = pa.list_(pa.float64())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, like = {}, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), like), pa.array([r.ravel().tolist() for r in held.values()], arrow)], names=["grp", "r"])

        for batch in batches:
            if not batch.num_rows:
                continue
            like = batch.column(0).type
            keys, x = batch.column(0).to_pylist(), _matrix(batch, 1)
            codes, names = pd.factorize(np.array(keys, dtype=object), use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                name = None if name is None or name is pd.NA or name != name else name
                rows = x[order[bounds[i]:bounds[i + 1]]]
                held[name] = triangle(np.concatenate([held[name], rows]) if name in held else rows)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "r": [combined(list(pdf["r"]), k).ravel().tolist()]})

    schema = f"grp {kind}, r array<double>"
    parts = data.mapInArrow(local, schema).withColumn("part", F.call_function("div", F.spark_partition_id(), F.lit(FAN)))
    return parts.groupBy("grp", "part").applyInPandas(join, schema).groupBy("grp").applyInPandas(join, schema)


def without_own(factors: DataFrame, n: int, k: int) -> DataFrame:
    """(id, r): for each of the ``n`` rows (id 0..n-1, r) of ``factors`` the triangle of all other rows.

    A tree over the ids: upwards ``FAN`` neighbours combine to one triangle, downwards each child gets what is
    outside its parent together with its siblings.  No triangle is ever subtracted."""
    schema = "id long, r array<double>"

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [int(pdf["id"].iloc[0]) // FAN], "r": [combined(list(pdf["r"]), k).ravel().tolist()]})

    def down(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above, rs = list(outer["r"]), list(own["r"])
        return pd.DataFrame({"id": own["id"], "r": [combined(above + rs[:i] + rs[i + 1:], k).ravel().tolist() for i in range(len(rs))]})

    parent = F.call_function("div", "id", F.lit(FAN)).alias("parent")
    levels = [factors.select(F.col("id").cast("long").alias("id"), "r")]
    while n > 1:
        levels.append(levels[-1].groupBy(parent).applyInPandas(up, schema))
        n = -(-n // FAN)
    outer = levels[-1].select("id", F.expr("cast(array() as array<double>)").alias("r"))
    for nodes in reversed(levels[:-1]):
        outer = nodes.groupBy(parent).cogroup(outer.groupBy(F.col("id").alias("parent"))).applyInPandas(down, schema)
    return outer


# --------------------------------------------------------------- least squares from R ---

def rank_of(r: np.ndarray, n: int) -> int:
    """Numerical rank of X from its triangle: columns of equal length, then pivoted elimination by Householder
    steps; a pivot below max(n, k) eps of the first ends it."""
    norms = np.linalg.norm(r, axis=0)
    a = r[:, norms > 0] / norms[norms > 0]
    rank, first = 0, None
    while a.size:
        left = np.linalg.norm(a, axis=0)
        j = int(left.argmax())
        first = first or left[j]
        if left[j] <= max(n, r.shape[1]) * np.finfo(float).eps * first:
            break
        q = a[:, j] / left[j]
        a = np.delete(a, j, axis=1)
        a = a - np.outer(q, q @ a)
        a = a - np.outer(q, q @ a)  # once more: what rounding left of q
        rank += 1
    return rank


def solve(r: np.ndarray, k: int) -> np.ndarray:
    """Least-squares coefficients of the last column of R on its first ``k``; of least norm if these are dependent."""
    return np.linalg.lstsq(r[:, :k], r[:, k], rcond=None)[0] if len(r) else np.zeros(k)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def t_pvalue(t: float, dof: int) -> float:
    """Two-sided p value of Student's t."""
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b
