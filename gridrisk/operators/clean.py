"""Cleaning (P8-P12, P22, P23) and gap interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col, strip_unit
from .joins import side_join
from .ranking import number_rows, rank_within, row_number_global

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


#: Most levels that become columns of their own.
MAX_LEVELS = 10_000


def levels(df: DataFrame, c: str) -> list:
    """Sorted non-null levels of a categorical (they become columns, so they reach the driver).  More than
    ``MAX_LEVELS`` raise: a table has no place for them, ``one_hot_vector`` has."""
    found = [r[0] for r in df.select(col(c)).where(col(c).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{c} has over {MAX_LEVELS} levels; use one_hot_vector")
    return sorted(found)


def one_hot(df: DataFrame, cols, drop_first: bool = True, skip_missing: bool = True, prefix_sep: str = "_") -> DataFrame:
    """One 0/1 column per level (``<col>_<level>``), first level in sort order
    dropped; NULL gives all zeros; the source column is replaced.  For more
    levels than a table should have columns, use ``one_hot_vector``."""
    out = df
    for c in cols:
        if c not in out.columns:
            if skip_missing:
                continue
            raise KeyError(c)
        lv = levels(out, c)
        if drop_first:
            lv = lv[1:]
        new = {f"{c}{prefix_sep}{v}": F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in lv}
        out = out.withColumns(new).drop(c)
    return out


def dictionary(df: DataFrame, c: str, index: str = "index") -> tuple[DataFrame, int]:
    """(level, ``index``) with the levels of a column numbered from 0 in sort order, and their number.
    Levels are numbered by ranges and never reach the driver; NULL is no level."""
    found = df.select(col(c).alias("level")).where(F.col("level").isNotNull()).distinct()
    numbered, n = number_rows(found, ["level"], index)
    return numbered.withColumn(index, F.col(index) - 1), n


def encode(df: DataFrame, c: str, index: str, drop_source: bool = False) -> tuple[DataFrame, int]:
    """The rows with each value's place in its ``dictionary`` (NULL for NULL), and the number of levels."""
    table, n = dictionary(df, c, index)
    out = side_join(df, table.select(F.col("level").alias(c), index), c, "left")
    return (out.drop(c) if drop_source else out), n


def one_hot_vector(df: DataFrame, cols, drop_first: bool = True, suffix: str = "_vec") -> DataFrame:
    """P8 for wide categoricals: a sparse vector ``<col><suffix>`` per column over the sorted levels (the first
    dropped); NULL gives all zeros; the source column is replaced.  Levels are numbered and joined back as a
    distributed dictionary; only their number reaches the driver."""
    from pyspark.ml.feature import OneHotEncoder

    out = df
    for c in cols:
        out, n = encode(out, c, "_oh_i", drop_source=True)
        # what has no place of its own (NULL and the dropped level) is an extra last category, which the encoder drops
        first = 1 if drop_first and n > 1 else 0
        place = F.when(F.col("_oh_i") >= first, F.col("_oh_i") - first).otherwise(F.lit(n - first)).cast("double")
        sizes = df.sparkSession.range(n - first + 1).select(F.col("id").cast("double").alias("_oh_p"))
        encoder = OneHotEncoder(inputCol="_oh_p", outputCol=f"{c}{suffix}", dropLast=True).fit(sizes)
        out = encoder.transform(out.withColumn("_oh_p", place)).drop("_oh_p", "_oh_i")
    return out


def strip_units(df: DataFrame, cols, unit: str) -> DataFrame:
    """P9 on a frame."""
    return df.withColumns({c: strip_unit(c, unit) for c in cols})


def to_numeric(df: DataFrame, cols) -> DataFrame:
    """P10: cast to DOUBLE, unparseable -> NULL (``try_cast``: ANSI-safe)."""
    return df.withColumns({c: col(c).try_cast("double") for c in cols})


def sentinel_to_null(df: DataFrame, cols=None, value: str = "none") -> DataFrame:
    """String values equal to the sentinel become NULL.

    The reference first finds the columns *containing* the sentinel and then
    replaces *equal* values; replacing equal values in every string column
    gives the same result without the extra scan.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(col(c), F.lit(value)) for c in cols})


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL -> 0 in numeric columns and '0' in string columns."""
    return df.na.fill(0).na.fill("0")


def mean_impute(train: DataFrame, test: DataFrame, cols) -> DataFrame:
    """M1: NULLs of ``test`` replaced by the column means of ``train`` (fit on
    train, apply to test).  The means are one row, broadcast; a column with no
    training value stays NULL (drop it first with ``drop_all_null``)."""
    means = train.agg(*[F.avg(col(c).cast("double")).alias(f"_mi_{i}") for i, c in enumerate(cols)])
    j = test.crossJoin(F.broadcast(means))
    j = j.withColumns({c: F.coalesce(col(c).cast("double"), F.col(f"_mi_{i}")) for i, c in enumerate(cols)})
    return j.drop(*[f"_mi_{i}" for i in range(len(cols))])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns with no non-NULL value (one aggregate pass; one row collected)."""
    counts = df.agg(*[F.count(col(c)).alias(c) for c in df.columns]).collect()[0].asDict()
    dead = [c for c, n in counts.items() if n == 0]
    return df.drop(*dead) if dead else df


def profile_columns(df: DataFrame, sentinel: str = "none") -> DataFrame:
    """Per column: type, rows, NULLs, all-NULL, numeric, sentinel hits,
    duplicated name.  One aggregate pass over columns addressed by position, so equal names and names with any
    sign are reported like others; one row, turned into a row per column."""
    fields = df.schema.fields
    names = [f.name for f in fields]
    placed = df.toDF(*[f"_p{i}" for i in range(len(names))])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i in range(len(names)):
        aggs.append(F.count_if(F.col(f"_p{i}").isNull()).alias(f"_n{i}"))
        aggs.append(F.count_if(F.coalesce(F.col(f"_p{i}").cast("string").contains(sentinel), F.lit(False))).alias(f"_s{i}"))
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.lit(isinstance(f.dataType, NUMERIC)).alias("is_numeric"), F.lit(names.count(f.name) > 1).alias("duplicated"),
                     F.col(f"_n{i}").alias("n_null"), F.col(f"_s{i}").alias("n_sentinel")) for i, f in enumerate(fields)]
    out = placed.agg(*aggs).select(F.col("_rows").alias("n_rows"), F.explode(F.array(*rows)).alias("_c")).select("n_rows", "_c.*")
    return out.withColumn("all_null", F.col("n_null") == F.col("n_rows"))


#: Blocks whose known points one task carries on; above that, blocks of blocks do.
CARRY_BLOCKS = 100_000


def _carry(blocks: DataFrame, part: list, at: str, lasts: list, firsts: list, before: list, after: list) -> DataFrame:
    """For each block (``part`` and number ``at``): the last known point of the blocks before it and the first of
    those behind it.  Within ``CARRY_BLOCKS`` neighbouring blocks by windows, beyond them through one row
    for each such run of blocks, so no task orders more than a run."""
    blocks = blocks.withColumn("_ca_run", F.floor(F.col(at) / CARRY_BLOCKS))
    run = part + ["_ca_run"]

    def along(keys, order, names, new, up):
        w = Window.partitionBy(*keys) if keys else Window.partitionBy()
        w = w.orderBy(F.col(order).asc() if up else F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return [F.last(c, ignorenulls=True).over(w).alias(x) for c, x in zip(names, new, strict=True)]

    near = blocks.select(*part, "_ca_run", at, *along(run, at, lasts, before, True), *along(run, at, firsts, after, False))
    runs = blocks.groupBy(*run).agg(*[F.max(c).alias(c) for c in lasts], *[F.min(c).alias(c) for c in firsts])
    far_b, far_a = [f"_ca_b{i}" for i in range(len(before))], [f"_ca_a{i}" for i in range(len(after))]
    far = runs.select(*run, *along(part, "_ca_run", lasts, far_b, True), *along(part, "_ca_run", firsts, far_a, False))
    out = side_join(near, far, run, "left", materialize=False)
    out = out.withColumns({c: F.coalesce(c, x) for c, x in zip(before + after, far_b + far_a, strict=True)})
    return out.drop("_ca_run", *far_b, *far_a)


def interpolate(df: DataFrame, cols, order_by, partition_by=(), block_rows: int = 100_000) -> DataFrame:
    """Linear interpolation of NULL gaps by row position inside each
    partition; leading/trailing gaps take the nearest value; an all-NULL
    partition stays NULL (pandas ``interpolate('linear', limit_direction='both')``).

    Distributed in two levels, so no partition (e.g. one station holding a
    third of the rows) is sorted in a single task:
      1. positions come from a range-partitioned global numbering;
      2. rows are cut into blocks of ``block_rows`` consecutive positions;
         inside a block, ``last/first(ignorenulls)`` windows find the nearest
         known (position, value) on each side, all columns in one window spec
         per direction;
      3. a table with one row per block carries the nearest known point into
         blocks that have none; it is ``block_rows`` times smaller than the data
         and is itself carried in levels (``_carry``).
    A NULL partition key is a partition of its own; every row is kept.
    """
    part = list(partition_by)
    order = list(order_by)
    if part:
        ranked = rank_within(df, part, order, name="_ip_pos").drop("_ip_pos_n")
    else:
        ranked = row_number_global(df, order, "_ip_rn").withColumn("_ip_pos", F.col("_ip_rn") - 1).drop("_ip_rn")
    ranked = ranked.withColumn("_ip_blk", F.floor(F.col("_ip_pos") / block_rows))
    bkey = part + ["_ip_blk"]

    def point(c):
        return F.when(col(c).isNotNull(), F.struct(F.col("_ip_pos").alias("p"), col(c).cast("double").alias("v")))

    # Both directions are running frames (UNBOUNDED PRECEDING .. CURRENT ROW),
    # which Spark evaluates incrementally; "next known value" is the running
    # last value in descending order.  A frame ending at UNBOUNDED FOLLOWING
    # would be re-aggregated for every row: quadratic in the block size.
    fwd = Window.partitionBy(*bkey).orderBy(F.col("_ip_pos").asc()).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*bkey).orderBy(F.col("_ip_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = ranked.withColumns({f"_ip_prev{i}": F.last(point(c), ignorenulls=True).over(fwd)
                                for i, c in enumerate(cols)})
    local = local.withColumns({f"_ip_next{i}": F.last(point(c), ignorenulls=True).over(bwd)
                               for i, c in enumerate(cols)})

    summary = ranked.groupBy(*bkey).agg(*[F.max(point(c)).alias(f"_ip_bl{i}") for i, c in enumerate(cols)],
                                         *[F.min(point(c)).alias(f"_ip_bf{i}") for i, c in enumerate(cols)])
    n = len(cols)
    firsts, lasts = [f"_ip_bf{i}" for i in range(n)], [f"_ip_bl{i}" for i in range(n)]
    carry = _carry(summary, part, "_ip_blk", lasts, firsts, [f"_ip_cp{i}" for i in range(n)], [f"_ip_cn{i}" for i in range(n)])
    joined = side_join(local, carry, bkey, "left", materialize=False)

    out = {}
    for i, c in enumerate(cols):
        prev = F.coalesce(F.col(f"_ip_prev{i}"), F.col(f"_ip_cp{i}"))
        nxt = F.coalesce(F.col(f"_ip_next{i}"), F.col(f"_ip_cn{i}"))
        span = nxt["p"] - prev["p"]
        lin = prev["v"] + (nxt["v"] - prev["v"]) * (F.col("_ip_pos") - prev["p"]) / F.when(span == 0, 1).otherwise(span)
        out[c] = (F.when(col(c).isNotNull(), col(c).cast("double"))
                   .when(prev.isNotNull() & nxt.isNotNull(), lin)
                   .when(prev.isNotNull(), prev["v"])
                   .otherwise(nxt["v"]))
    helper = [x for x in joined.columns if x.startswith("_ip_")]
    return joined.withColumns(out).drop(*helper)
