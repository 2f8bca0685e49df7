"""Fits that don't depend on one another, run side by side and kept as they finish (M6, H1, H2, FS2).

Folds and candidates are submitted from a bounded number of threads, each in a scheduler pool of its own (fair
among each other where the session's scheduler is FAIR); every fit is a distributed MLlib job.  What a fit yields
is written to a folder at once: a score as a row of a ledger, predictions as a Parquet folder.  A
later run with the same folder skips what is there, so a lost driver costs the unfinished fits only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from hashlib import md5

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import col
from ..session import ensure_checkpoint_dir

#: Fits that run at a time.
WIDTH = 4


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]], width: int = WIDTH) -> list:
    """Results of the jobs in their order; the first error is raised once all have ended."""
    def in_pool(i: int, job: Callable[[], object]):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{i % width}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, width)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(in_pool), i, job) for i, job in enumerate(jobs)]
        errors = [e for e in (s.exception() for s in started) if e]
    if errors:
        raise errors[0]
    return [s.result() for s in started]


class Ledger:
    """Finished results by key: each is a committed one-row table in a folder of its own (writers side by side don't
    meet), so a killed run leaves whole rows."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path or new_folder(spark, "ledger")
        self.spark.createDataFrame([], "key string, value string").write.mode("overwrite").json(f"{self.path}/empty")

    def done(self) -> dict[str, object]:
        rows = self.spark.read.schema("key string, value string").option("recursiveFileLookup", True).json(self.path).collect()  # one short row per fit
        return {r["key"]: json.loads(r["value"]) for r in rows}

    def add(self, key: str, value) -> None:
        row = self.spark.createDataFrame([(key, json.dumps(value))], "key string, value string").coalesce(1)
        row.write.mode("overwrite").json(f"{self.path}/{md5(key.encode()).hexdigest()}")


def run_kept(spark: SparkSession, jobs: dict[str, Callable[[], object]], path: str | None = None, width: int = WIDTH) -> dict[str, object]:
    """``{key: result}`` of all jobs; results (JSON values) already in the ledger at ``path`` aren't computed again."""
    ledger = Ledger(spark, path)
    done = ledger.done()

    def job(key: str, f: Callable[[], object]):
        value = f()
        ledger.add(key, value)
        return key, value

    left = [lambda k=k, f=f: job(k, f) for k, f in jobs.items() if k not in done]
    found = dict(side_by_side(spark, left, width))
    return {k: found.get(k, done.get(k)) for k in jobs}


def map_text(param_map) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(param_map.items(), key=lambda kv: kv[0].name))


def fit_others(df: DataFrame) -> Callable:
    """``fit(estimator, fold, k)``: a model of all rows outside fold k."""
    return lambda estimator, fold, k: estimator.fit(df.where(F.col(fold) != k))


class Search:
    """Scores of every candidate and fold, and the best candidate fitted on all rows.  ``fit`` fits on all folds but
    one (default: ``fit_others``)."""

    def __init__(self, df: DataFrame, estimator, maps: list, evaluator, fold: str, path: str | None = None, width: int = WIDTH,
                 fit: Callable | None = None):
        spark = df.sparkSession
        fit = fit or fit_others(df)
        self.maps, self.folds = maps, sorted(r[0] for r in df.select(fold).distinct().collect())  # one value a fold

        def score(param_map, k):
            model = fit(estimator.copy(param_map), fold, k)
            return float(evaluator.evaluate(model.transform(df.where(F.col(fold) == k))))

        jobs = {f"{map_text(m)} | {k}": lambda m=m, k=k: score(m, k) for m in maps for k in self.folds}
        got = run_kept(spark, jobs, path, width)
        self.scores = [[got[f"{map_text(m)} | {k}"] for k in self.folds] for m in maps]
        self.avgMetrics = [sum(s) / len(s) for s in self.scores]
        pick = max if evaluator.isLargerBetter() else min
        self.best = pick(range(len(maps)), key=lambda i: self.avgMetrics[i])
        self._fit = lambda: estimator.copy(maps[self.best]).fit(df)
        self._model = None

    @property
    def bestModel(self):
        """The best candidate's model of all rows, fitted on first use."""
        self._model = self._model or self._fit()
        return self._model

    def getEstimatorParamMaps(self):
        return self.maps

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(map_text(m), int(k), s) for m, row in zip(self.maps, self.scores, strict=True) for k, s in zip(self.folds, row, strict=True)]
        return spark.createDataFrame(rows, "params string, fold int, score double")


def predict_folds(df: DataFrame, estimator, fold: str, prediction: str = "prediction", path: str | None = None, width: int = WIDTH,
                  fit: Callable | None = None, columns=None) -> DataFrame:
    """For every fold a model of the other folds (``fit``, default: ``fit_others``) predicts it.  Each fold's rows (all
    columns, or those named, and the prediction) are written to a folder of its own as it finishes and all are read back
    as one table, so the plan doesn't grow with the folds."""
    spark = df.sparkSession
    fit = fit or fit_others(df)
    path = path or new_folder(spark, "folds")
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # one value a fold

    def one(k):
        model = fit(estimator, fold, k)
        out = model.transform(df.where(F.col(fold) == k)).withColumnRenamed("prediction", prediction)
        if columns is not None:
            out = out.select(*[col(c) for c in columns], prediction)
        out.write.mode("overwrite").parquet(f"{path}/rows/fold-{k}")
        return k

    run_kept(spark, {f"fold {k}": lambda k=k: one(k) for k in folds}, f"{path}/ledger", width)
    return spark.read.parquet(*[f"{path}/rows/fold-{k}" for k in folds])
