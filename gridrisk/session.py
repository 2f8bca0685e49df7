"""Session construction and lineage helpers.

The library never hard-codes cluster paths: the checkpoint folder is read from
``spark.checkpoint.dir``.  Only a *local* session (tests, bench) that has no
such setting gets a scratch folder of its own.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "gridrisk", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; invent one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="gridrisk-ckpt-", dir=os.environ.get("GRIDRISK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to a cluster's executors, once a session: their Python workers import what kernels
    refer to, and a cluster's nodes may not have the package installed."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        return
    package = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
    _SHIPPED.add(sc.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local checkpoint.

    The checkpointed plan keeps the attribute ids of the original lineage;
    re-aliasing gives fresh ids so that joining the copy back to a frame of
    the same lineage is never an ambiguous self-join."""
    from pyspark.sql import functions as F

    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


#: Rows that a task reads of a materialised input, where there are more than two tasks a core.
TASK_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for jobs over so many rows: two a core, and more once each would read over ``TASK_ROWS``."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Checkpoint an input that several jobs (e.g. model fits) will read, spread over ``partitions``
    (default: ``spark.sql.shuffle.partitions``, which a cluster sets to its data).

    AQE coalesces small shuffle outputs into very few partitions and a checkpoint would keep that
    layout, leaving every later job with a few tasks; so rows are spread before the one write.

    ``spark.sql.shuffle.partitions`` follows the largest table of a cluster, and a panel may be far smaller: a fit
    is many short jobs, each with a shuffle between all its tasks.  So without ``partitions`` the written parts are
    read by no more tasks than their rows need (``tasks_for``); the rows and their order stay."""
    want = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cut_lineage(df.repartition(want))
    if partitions or want <= tasks_for(df.sparkSession, 0):
        return out
    return out.coalesce(min(want, tasks_for(df.sparkSession, out.count())))
