"""Distributed ranking: row numbers in a total order without a one-task window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row into a
single task, and ``PARTITION BY group`` moves a whole group into one task.  The
helpers here instead range-partition on the order key (so one hot group is cut
across many tasks), number rows inside each range, and add per-range offsets
from a table with one row per partition (a size bound known in advance, so it
is broadcast).

The range-partitioned, numbered layout is checkpointed once (to the
cluster's checkpoint folder) so that the per-partition counts and the row ids
come from the same layout.  The order key must be unique for
identity-sensitive uses (fold ids, permutations); with ties, tie order is
arbitrary but values at each position are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _n_partitions(df: DataFrame, partitions: int | None) -> int:
    """The given number of ranges, else ``spark.sql.shuffle.partitions``, which a cluster sets to its data (a number
    given to a repartition isn't split at run time)."""
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def number_rows(df: DataFrame, order_cols, name: str = "rn",
                partitions: int | None = None) -> tuple[DataFrame, int]:
    """``row_number_global`` plus the total row count, taken from the
    per-partition counts (no second pass over the input)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    n = _n_partitions(df, partitions)
    ranged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn("_rk_pid", F.spark_partition_id())
                .withColumn("_rk_mid", F.monotonically_increasing_id()))
    # Range bounds are sampled from the input and ids depend on the layout, so
    # every consumer must read one materialised layout: a reliable checkpoint
    # (also what makes the numbering survive a lost executor).
    ranged = cut_lineage(ranged)
    per_part = ranged.groupBy("_rk_pid").agg(F.count(F.lit(1)).alias("_rk_n"),
                                            F.min("_rk_mid").alias("_rk_base"))
    # one row per partition: the window below sorts at most `n` rows
    w = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(per_part.withColumn("_rk_off", F.coalesce(F.sum("_rk_n").over(w), F.lit(0))))
    total = offsets.agg(F.coalesce(F.sum("_rk_n"), F.lit(0))).first()[0]
    out = ranged.join(F.broadcast(offsets.select("_rk_pid", "_rk_off", "_rk_base")), "_rk_pid")
    out = out.withColumn(name, F.col("_rk_off") + (F.col("_rk_mid") - F.col("_rk_base")) + 1)
    return out.drop("_rk_pid", "_rk_mid", "_rk_off", "_rk_base"), int(total)


def row_number_global(df: DataFrame, order_cols, name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``ORDER BY order_cols`` (ascending, nulls first)."""
    return number_rows(df, order_cols, name, partitions)[0]


def rank_within(df: DataFrame, group_cols, order_cols, name: str = "pos",
                partitions: int | None = None) -> DataFrame:
    """0-based position of a row inside its group (``row_number() - 1`` per group); a NULL key is a
    group of its own.

    A group's first global row number comes from a grouped ``min`` (partial
    aggregation, so a hot group costs one value per task) and is joined back
    null-safely.
    """
    from .joins import side_join  # local import: joins -> session only

    ranked = row_number_global(df, list(group_cols) + list(order_cols), "_rw_rn", partitions)
    starts = ranked.groupBy(*group_cols).agg(F.min("_rw_rn").alias("_rw_start"),
                                            F.count(F.lit(1)).alias("_rw_n"))
    out = side_join(ranked, starts, list(group_cols), "inner", materialize=False)
    return (out.withColumn(name, F.col("_rw_rn") - F.col("_rw_start"))
               .withColumnRenamed("_rw_n", f"{name}_n")
               .drop("_rw_rn", "_rw_start"))


def running_total(df: DataFrame, order_cols, weight: str, name: str, partitions: int | None = None) -> DataFrame:
    """``name``: sum of ``weight`` over all rows before this one in ``ORDER BY order_cols`` (which must
    be unique).  Sums run inside each range; a table with one row per range carries them on."""
    n = _n_partitions(df, partitions)
    order = [F.col(c) for c in order_cols]
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_rt_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_rt_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per_part = ranged.groupBy("_rt_pid").agg(F.sum(weight).alias("_rt_sum"))
    ahead = Window.orderBy("_rt_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = per_part.select("_rt_pid", F.coalesce(F.sum("_rt_sum").over(ahead), F.lit(0)).alias("_rt_off"))
    out = ranged.withColumn("_rt_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(offsets), "_rt_pid")
    return out.withColumn(name, F.col("_rt_off") + F.col("_rt_in")).drop("_rt_pid", "_rt_in", "_rt_off")


def dense_rank_keys(df: DataFrame, key_cols, name: str = "rank",
                    partitions: int | None = None) -> DataFrame:
    """1-based dense rank of the distinct key tuples (one row per key)."""
    keys = df.select(*key_cols).distinct()
    return row_number_global(keys, list(key_cols), name, partitions)


def ntile_global(df: DataFrame, k: int, order_cols, name: str = "tile",
                 partitions: int | None = None) -> DataFrame:
    """``ntile(k) OVER (ORDER BY order_cols)`` (0-based), distributed.

    With n rows, q = n div k and r = n mod k, the first r tiles hold q+1 rows.
    """
    ranked, total = number_rows(df, order_cols, "_nt_rn", partitions)
    out = ranked.withColumn("_nt_total", F.lit(total))
    q = F.floor(F.col("_nt_total") / k)
    r = F.col("_nt_total") % k
    i = F.col("_nt_rn") - 1
    big = r * (q + 1)
    tile = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1))))
    return out.withColumn(name, tile.cast("int")).drop("_nt_rn", "_nt_total")
