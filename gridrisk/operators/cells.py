"""Tree regressors fitted on the cells of their bins (L2, L4, L5 over many rows and few features).

MLlib's trees know a feature by its bin alone (``maxBins``), and the splits and leaves of a regression tree
depend on its rows by their number, sum and sum of squares of the label.  So the rows of one combination of
bins are a cell with three sums.  MLlib reads all rows once for each level of each tree; here a training set is read
three times, to check its values, for the bin edges and for the sums, and its trees grow on the cells, of which there are
as many however many the rows.

Every row is in the sums: of each bootstrap draw (Poisson, for each row) or subsample (Bernoulli, for each row) a
tree has sums of its own, and the residuals of boosting follow from the sums, as all rows of a cell have one
prediction.  Edges are found by MLlib's rule, on quantiles of all training rows (MLlib: on a random sample of 10,000).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from threading import Lock
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..session import ship, tasks_for

#: Cells at most, so that sums of one draw (three doubles a cell) fit the driver and predictions a broadcast.
CELLS = 1 << 16
#: Draws that one pass sums, and rows that a task draws for at once.
DRAWS, STEP = 32, 1 << 16
KINDS = ["all", "poisson", "bernoulli"]
#: Neighbouring cells whose sums go from task to task as one value, and such values' columns.
BLOCK, BLOCKS = 1 << 12, "draw int, block int, sums binary"
#: Bytes of sums that are kept for fits to come.
KEEP = 1 << 29
#: Quantiles that edges are found on, known to one part in as many.
QUANTILES = 10_000
EPSILON = float(np.finfo(float).eps)


# --------------------------------------------------------------------- bins ---

def edges(values, bins: int) -> list[float]:
    """MLlib's thresholds of a continuous feature: between all neighbours if these are few, else where the
    count of values is nearest to multiples of the stride."""
    v, n = np.unique(np.asarray(values, dtype=float), return_counts=True)
    middle = ((v[:-1] + v[1:]) / 2).tolist()
    if len(middle) <= bins - 1:
        return middle
    upto, stride, out = np.cumsum(n), n.sum() / bins, []
    target = stride
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return out


def bin_sql(x: str, cuts: list[float], first: int = 0) -> str:
    """SQL: how many cuts are below x, by bisection; NULL and NaN are in the last bin, where a tree's walk takes them."""
    if not cuts:
        return str(first)
    mid = len(cuts) // 2
    return f"CASE WHEN {x} <= {number_sql(cuts[mid])} THEN {bin_sql(x, cuts[:mid], first)} ELSE {bin_sql(x, cuts[mid + 1:], first + mid + 1)} END"


def number_sql(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"double('{v!r}')"


class Grid:
    """The bins of one training set: cuts of every feature and the number of rows."""

    def __init__(self, features: list[str], cuts: list[list[float]], rows: int):
        self.features, self.cuts, self.rows = features, cuts, rows
        self.sizes = [len(c) + 1 for c in cuts]
        self.cells = math.prod(self.sizes)

    def cell(self) -> Column:
        at = "0"
        for c, cuts, size in zip(self.features, self.cuts, self.sizes, strict=True):
            x = "CAST(`" + c.replace("`", "``") + "` AS DOUBLE)"
            at = f"({at}) * {size} + {bin_sql(x, cuts)}"
        return F.expr(at)

    def bins(self) -> np.ndarray:
        """Bin of every feature (rows) in every cell (columns)."""
        return np.indices(self.sizes).reshape(len(self.sizes), -1)


def grid_of(train: DataFrame, features: list[str], label: str, bins: int) -> Grid | None:
    """The grid of the training rows; None where cells don't help (too many, or no fewer than the rows) or a
    value isn't finite (MLlib's own fit reports that)."""
    xs = [col(c).cast("double") for c in features]
    known = [x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) for x in [*xs, col(label).cast("double")]]
    rows, good, *distinct = train.agg(F.count(F.lit(1)), F.count(F.when(F.array_min(F.array(*known)), 1)),
                                      *[F.approx_count_distinct(x) for x in xs]).first()
    if not rows or good < rows or math.prod(min(d, bins) for d in distinct) > min(CELLS, rows):
        return None
    n = min(rows, QUANTILES)  # up to so many rows these are all values, each once
    at = F.expr(f"array({', '.join(number_sql((i + 0.5) / n) for i in range(n))})")
    # few tasks: each hands a summary of thousands of values to the last one
    few = train.coalesce(tasks_for(train.sparkSession, 0))
    found = few.agg(*[F.percentile_approx(x, at, QUANTILES) for x in xs]).first()
    grid = Grid(features, [edges(values, bins) for values in found], rows)
    return grid if grid.cells <= CELLS and grid.cells < grid.rows else None


# --------------------------------------------------------------------- sums ---

class Draws(NamedTuple):
    """``number`` draws of the rows, each for a tree, or all rows once for all trees."""

    kind: str
    rate: float
    number: int
    seed: int


def draws_of(est) -> Draws:
    rate, seed = est.getSubsamplingRate(), est.getSeed() % (1 << 64)
    if isinstance(est, RandomForestRegressor) and est.getBootstrap():
        return Draws("poisson", rate, est.getNumTrees(), seed)
    if rate >= 1:
        return Draws("all", 1.0, 1, 0)
    return Draws("bernoulli", rate, est.getMaxIter() if isinstance(est, GBTRegressor) else est.getNumTrees(), seed)


def drawn(rng: np.random.Generator, kind: str, rate: float, n: int) -> np.ndarray:
    """How often each of n rows is drawn."""
    if kind == "all":
        return np.ones(n)
    u = rng.random(n)
    if kind == "bernoulli":
        return (u < rate).astype(float)
    times = np.zeros(n)
    p = upto = math.exp(-rate)
    for k in range(1, 200):  # how many of the distribution's steps lie up to u
        times += u >= upto
        p *= rate / k
        if upto + p <= upto:
            break
        upto += p
    return times


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches' rows in tables of about ``STEP`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STEP:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def added(parts: pa.Table) -> pa.Table:
    """One block of cells: its sums over all tasks."""
    total = sum(np.frombuffer(x.as_buffer()) for x in parts["sums"])
    return pa.table({"draw": parts["draw"][:1], "block": parts["block"][:1], "sums": pa.array([total.tobytes()])})


def cell_sums(train: DataFrame, grid: Grid, label: str, wanted: list[Draws]) -> dict[Draws, np.ndarray]:
    """[draw, (rows, sum, sum of squares), cell] over all training rows.  A task draws for each of its rows and holds the sums of
    ``DRAWS`` draws at a time; draws follow the seed and the input's partitions, as MLlib's do."""
    ship(train.sparkSession)
    cells, blocks = grid.cells, -(-grid.cells // BLOCK)
    rows = train.select(grid.cell().alias("cell"), col(label).cast("double").alias("y")).coalesce(tasks_for(train.sparkSession, 0))
    every = [(d, t) for d in wanted for t in range(d.number)]
    out = {d: np.zeros((d.number, 3, cells)) for d in wanted}
    for begin in range(0, len(every), DRAWS):
        some = every[begin:begin + DRAWS]

        def local(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            rngs = [np.random.default_rng([d.seed, KINDS.index(d.kind), t, part]) for d, t in some]
            sums = np.zeros((len(some), 3, cells))
            for table in steps(batches):
                c, y = table["cell"].to_numpy(), table["y"].to_numpy()
                for (d, _), rng, into in zip(some, rngs, sums, strict=True):
                    w = drawn(rng, d.kind, d.rate, len(c))
                    for i in range(3):  # of w, w y and w y y
                        into[i] += np.bincount(c, w, cells)
                        w = w * y
            for i, of in enumerate(sums):
                values = [of[:, b * BLOCK:(b + 1) * BLOCK].tobytes() for b in range(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * blocks, pa.int32()), pa.array(range(blocks), pa.int32()), pa.array(values)], names=["draw", "block", "sums"])

        parts = rows.mapInArrow(local, BLOCKS).groupBy("draw", "block").applyInArrow(added, BLOCKS)
        got = parts.toArrow()
        for i, block, part in zip(got["draw"].to_pylist(), got["block"].to_pylist(), got["sums"], strict=True):
            (d, t), at = some[i], block * BLOCK
            out[d][t, :, at:at + BLOCK] = np.frombuffer(part.as_buffer()).reshape(3, -1)
    return out


# -------------------------------------------------------------------- trees ---

def subset_size(strategy: str, k: int, trees: int) -> int:
    """Features that a split may choose from, by MLlib's names."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {"all": k, "sqrt": math.ceil(math.sqrt(k)), "log2": max(1, math.ceil(math.log2(k))), "onethird": math.ceil(k / 3)}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), k) if strategy.isdigit() else math.ceil(float(strategy) * k)


def grow(sums: np.ndarray, bins: np.ndarray, sizes: list[int], depth: int, least: int, gain: float, subset: int,
         rng: np.random.Generator) -> np.ndarray:
    """Prediction of every cell by one regression tree (MLlib's variance gain, level by level; a split leaves
    ``least`` rows on both sides and gains at least ``gain``)."""
    out = np.zeros(sums.shape[1])
    live, node, m = np.arange(sums.shape[1]), np.zeros(sums.shape[1], dtype=int), 1  # cells of nodes that may split
    for level in range(depth + 1):
        n, s, q = (np.bincount(node, w[live], m) for w in sums)
        mean = np.divide(s, n, out=np.zeros(m), where=n > 0)
        out[live] = mean[node]
        if level == depth:
            break
        impurity = np.divide(q, n, out=np.zeros(m), where=n > 0) - mean ** 2
        best, on, cut = np.full(m, -np.inf), np.zeros(m, dtype=int), np.zeros(m, dtype=int)
        may = rng.random((m, len(sizes))).argsort(axis=1) < subset
        for f, size in enumerate(sizes):
            if size == 1:
                continue
            at = node * size + bins[f, live]
            ln, ls, lq = (np.bincount(at, w[live], m * size).reshape(m, size).cumsum(axis=1)[:, :-1] for w in sums)
            rn, rs, rq = n[:, None] - ln, s[:, None] - ls, q[:, None] - lq
            with np.errstate(divide="ignore", invalid="ignore"):
                left, right = lq / ln - (ls / ln) ** 2, rq / rn - (rs / rn) ** 2
                g = impurity[:, None] - ln / n[:, None] * left - rn / n[:, None] * right
            g[(ln < least) | (rn < least) | ~(g >= gain) | ~may[:, f][:, None]] = -np.inf
            first = g.argmax(axis=1)
            g = g[np.arange(m), first]
            better = g > best
            best[better], on[better], cut[better] = g[better], f, first[better]
        split = (best > 0) & (impurity >= EPSILON)
        if not split.any():
            break
        goes = split[node]
        live, node = live[goes], node[goes]
        node = 2 * (np.cumsum(split) - 1)[node] + (bins[on[node], live] > cut[node])
        m = 2 * int(split.sum())
    return out


def predictions(est, sums: np.ndarray, grid: Grid) -> np.ndarray:
    """Prediction of every cell by the estimator's trees."""
    k, bins, rng = len(grid.sizes), grid.bins(), np.random.default_rng(est.getSeed())
    boosted = isinstance(est, GBTRegressor)
    limits = (est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMinInfoGain(),
              subset_size(est.getFeatureSubsetStrategy(), k, 1 if boosted else est.getNumTrees()))
    trees = est.getMaxIter() if boosted else est.getNumTrees()
    total = np.zeros(grid.cells)
    for t in range(trees):
        n, s, q = sums[t % len(sums)]
        if boosted and t:  # of the residuals 2 (y - total), the negative gradient of the squared error
            n, s, q = n, 2 * (s - n * total), np.maximum(4 * (q - 2 * total * s + n * total ** 2), 0.0)
        tree = grow(np.array([n, s, q]), bins, grid.sizes, *limits, rng)
        total += tree * ((est.getStepSize() if t else 1.0) if boosted else 1.0 / trees)
    return total


class CellModel:
    """Predictions of rows by their cells."""

    def __init__(self, spark, grid: Grid, values: np.ndarray, prediction: str):
        self.grid, self.prediction = grid, prediction
        self.values = spark.createDataFrame(pa.table({"_ce_cell": pa.array(np.arange(grid.cells), pa.int32()), prediction: values}))

    def transform(self, df: DataFrame) -> DataFrame:
        # one row a cell, every cell (at most CELLS): a proven size bound
        found = df.withColumn("_ce_cell", self.grid.cell()).join(F.broadcast(self.values), "_ce_cell", "left")
        return found.select(*[col(c) for c in [*df.columns, self.prediction]])


def fits_cells(est) -> bool:
    """Whether the estimator's trees depend on rows by the sums alone."""
    if not isinstance(est, RandomForestRegressor | GBTRegressor) or est.isDefined(est.weightCol) or est.getMinWeightFractionPerNode() > 0:
        return False
    return not isinstance(est, GBTRegressor) or (est.getLossType() == "squared" and not est.isDefined(est.validationIndicatorCol))


class Fits:
    """Fits of estimators on all folds but one: on cells where the rows outnumber them, else by the estimator on
    the rows.  The grid and sums of a training set are found once for all candidates, and for all ``estimators`` in
    one pass if their draws are few; sums are kept up to ``KEEP`` bytes, those used last."""

    def __init__(self, df: DataFrame, features, label: str, estimators=()):
        self.df, self.features, self.label = df, list(features), label
        self.others = [(e.getMaxBins(), draws_of(e)) for e in estimators if fits_cells(e)]
        self._kept: dict = {}
        self._lock = Lock()

    def _once(self, key: tuple, make):
        with self._lock:
            value, lock = self._kept[key] = self._kept.pop(key, ([], Lock()))
        with lock:
            if not value:
                value.append(make())
            found = value[0]
        with self._lock:
            sums = [(k, sum(x.nbytes for x in v[0].values())) for k, (v, _) in self._kept.items() if k[0] == "sums" and v]
            left = sum(n for _, n in sums)
            for old, n in sums:
                if left > KEEP:
                    del self._kept[old]
                    left -= n
        return found

    def __call__(self, est, fold: str, k):
        train = self.df.where(F.col(fold) != k)
        if not fits_cells(est):
            return est.fit(train)
        bins, own = est.getMaxBins(), draws_of(est)
        grid = self._once(("grid", fold, k, bins), lambda: grid_of(train, self.features, self.label, bins))
        if grid is None:
            return est.fit(train)
        wanted = sorted({own, *(d for b, d in self.others if b == bins)})
        if sum(d.number for d in wanted) > DRAWS:
            wanted = [own]
        sums = self._once(("sums", fold, k, bins, *wanted), lambda: cell_sums(train, grid, self.label, wanted))
        return CellModel(self.df.sparkSession, grid, predictions(est, sums[own], grid), est.getPredictionCol())
