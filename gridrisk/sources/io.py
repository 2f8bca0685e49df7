"""Scans and sinks.

The reference reads whole CSVs with inferred types and coerces later; here a
scan takes an explicit schema when one is known, reads parquet by default (so
column pruning and filter pushdown reach the files) and turns floating NaN into
NULL, because Spark orders NaN above every number while pandas treats it as
missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geojson


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """NaN -> NULL on floating columns (projection only, stays in codegen)."""
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols)]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets})


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", **opts) -> DataFrame:
    """Read a panel or metric table; CSV gets a header and, when given, a schema."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in opts.items():
        reader = reader.option(k, v)
    return nan_to_null(reader.load(path))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_geojson(spark: SparkSession, path: str, key: str = "grid", seq: bool = False,
                 feature_schema: str | T.StructType | None = None, split_bytes: int | None = None) -> DataFrame:
    """One row per GeoJSON feature, properties flattened next to ``geometry``.

    Reads a FeatureCollection file (``multiLine``: one record and one task per file; with ``split_bytes``, which
    needs a schema, by ranges of so many bytes in several tasks, see ``sources.geojson``) or GeoJSON-seq lines (one feature
    per line, split across tasks like any JSON lines input).  A known
    ``feature_schema`` (DDL of one Feature) skips the schema-inference pass.
    ``seq`` says which of the two forms the files have; nothing is read to guess it.
    """
    if seq:
        reader = spark.read.schema(feature_schema) if feature_schema is not None else spark.read
        feats = reader.json(path).select(F.struct("*").alias("f"))
    elif split_bytes:
        if feature_schema is None:
            raise ValueError("split_bytes needs feature_schema")
        geojson.register(spark)
        text = spark.read.format("feature_collection").option("splitBytes", split_bytes).load(path)
        feats = text.select(F.from_json("feature", feature_schema).alias("f"))
    else:
        reader = spark.read.option("multiLine", True)
        if feature_schema is not None:
            fs = (spark.createDataFrame([], feature_schema).schema if isinstance(feature_schema, str)
                  else feature_schema)
            reader = reader.schema(T.StructType([T.StructField("features", T.ArrayType(fs))]))
        feats = reader.json(path).select(F.explode("features").alias("f"))
    props = feats.select("f.properties.*").columns
    out = feats.select(*[F.col(f"f.properties.`{p}`").alias(p) for p in props],
                       F.col("f.geometry").alias("geometry"))
    if key not in out.columns:
        raise ValueError(f"feature properties have no '{key}'")
    return out


def write_collections(features: DataFrame, path: str) -> None:
    """One column of features as JSON text -> a folder of FeatureCollection files, one for each partition, a feature a
    line.  Rows pass through in Arrow batches: nothing is sorted or held, whatever a file's size."""
    geojson.ship(features.sparkSession)
    features.mapInArrow(geojson.collection_lines, "value string").write.text(path)


def write_geojson_seq(df: DataFrame, path: str, geometry: str = "geometry", mode: str = "overwrite") -> None:
    """Write features as GeoJSON-seq (one Feature per line, every task writes
    its own file): properties = all columns but the geometry."""
    props = [c for c in df.columns if c != geometry]
    df.select(F.lit("Feature").alias("type"),
              F.struct(*[F.col(f"`{c}`") for c in props]).alias("properties"),
              F.col(geometry).alias("geometry")).write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(),
                mode: str = "overwrite") -> None:
    """K1: write a directory (one file per task); CSV carries a header, no index column."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def z_order(x, y, bits: int = 16):
    """A space-filling key of two columns scaled to 0..1: their bits in turn."""
    top = float((1 << bits) - 1)
    cells = [F.rint(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * top).cast("long") for c in (x, y)]
    key = F.lit(0).cast("long")
    for i in range(bits):
        for shift, c in enumerate(cells):
            key = key + F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), 2 * i + shift)
    return key


def write_weeks(df: DataFrame, path: str, week: str = "week", near: tuple[str, str] | None = None,
                bounds: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)) -> None:
    """A layer in one folder a week.  Only the weeks that ``df`` has are replaced (dynamic partition
    overwrite), so a week can be written again without touching the others.  With ``near`` (two coordinate
    columns within ``bounds``) a week's rows are cut into files along a space-filling curve, so a box of the map
    reads the files whose ranges it meets."""
    out = df
    if near:
        x0, y0, x1, y1 = bounds
        x, y = ((F.col(f"`{c}`") - lo) / (hi - lo) for c, lo, hi in zip(near, (x0, y0), (x1, y1), strict=True))
        out = out.withColumn("_z", F.coalesce(z_order(x, y), F.lit(-1).cast("long")))
        out = out.repartitionByRange(week, "_z").sortWithinPartitions(week, "_z").drop("_z")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(week).parquet(path)


def metrics_long(df: DataFrame, id_cols=()) -> DataFrame:
    """K2: a wide one-row (or per-id) metric frame as long (metric, value) rows."""
    metric_cols = [c for c in df.columns if c not in id_cols]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in metric_cols])
    return df.select(*[F.col(f"`{c}`") for c in id_cols], F.explode(pairs).alias("_m")).select(*[f"`{c}`" for c in id_cols], "_m.*")
