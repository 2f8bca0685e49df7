"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir  # noqa: F401  (re-exported)

#: Text bytes that one step of an Arrow kernel holds at a time (one longer text is a step of its own).
STEP_BYTES = 1 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python needs the kernels, and a
    cluster's nodes may not have the package installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under the names ``id`` and ``text``: whatever other columns a
    table brings, they can't clash with an operator's own."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` has about ``limit`` bytes, so a kernel's memory
    follows the text in hand and not the number of rows in a batch."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())).cumsum()
    at = 0
    while at < n:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def list_column(parts: list[bytes], dtype=np.int32) -> pa.Array:
    """An Arrow list column whose rows are the little-endian numbers in ``parts``."""
    width = np.dtype(dtype).itemsize
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=dtype)))


#: Bytes of rows in one Arrow batch on its way to or from Python.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, not by 10,000 rows of whatever size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_HELD: dict = {}


def release() -> None:
    """Give back to the system what a worker no longer uses: freed memory would stay with the process otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's; others have none
    if trim:
        trim(0)


def let_go() -> None:
    """For kernels that need nothing that is held: what the last one held goes."""
    _HELD.clear()
    release()


def held(kind: str, key, make):
    """What a kernel needs again and again (a vocabulary, dictionaries), made once a worker.  A worker holds one such
    thing: when another kernel takes its turn in a reused worker, what the last one held goes."""
    if (kind, key) not in _HELD:
        let_go()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


class Scratch:
    """Tables written to the shared checkpoint folder and read back, for steps that several jobs read.

    A reread table has no lineage, sizes the planner knows, and no constraints of earlier steps (these
    grow with every round of an iteration that is cut by checkpoints alone).  ``close`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, 0
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Most buckets that ``with_next`` makes; their bounds (one integer each) are broadcast.
MAX_BUCKETS = 100_000


def with_next(rows: DataFrame, columns: list[str], per_bucket: int = 2000) -> DataFrame:
    """``rows`` and ``next_<column>`` of the row behind in ascending order of the integer ``id``
    (nulls first, repeated ids by ``columns``); behind the last row comes the first.

    Buckets hold ranges of ids, about ``per_bucket`` rows each, and each bucket also gets the first
    row of the one behind it, so the wide columns are shuffled once and a task sees whole buckets
    only, never the table."""
    spark = rows.sparkSession
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    keys = rows.select(key.alias("k"))
    n = min(MAX_BUCKETS, max(1, -(-keys.count() // per_bucket)))
    ranges = keys.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    bounds = spark.sparkContext.broadcast(np.array(sorted(r["k"] for r in ranges.collect()), dtype=np.int64))

    @F.arrow_udf("struct<bucket: int, first: boolean>")
    def place(keys: pa.Array) -> pa.Array:
        least, k = bounds.value, keys.to_numpy(zero_copy_only=False)
        at = np.searchsorted(least, k, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(least[at] == k)], names=["bucket", "first"])

    put = rows.withColumn("k", key).withColumn("at", place.asNondeterministic()("k"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("at.bucket") - 1, F.lit(max(1, len(bounds.value)))).alias("bucket"), F.lit(True).alias("tail"))
    dealt = put.withColumn("to", F.explode(F.when(F.col("at.first"), F.array(own, before)).otherwise(F.array(own))))
    by = Window.partitionBy("to.bucket").orderBy("to.tail", "k", *columns)
    out = dealt.select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in columns])
    return out.filter("not to.tail").drop("k", "at", "to")
