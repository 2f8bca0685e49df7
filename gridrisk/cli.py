"""Command line: run an analysis on panel files and write its tables.

    python -m gridrisk.cli risk   --panel grid_day.csv --out results/ [--exclude 138,355]
    python -m gridrisk.cli volume --panel site_day.csv --out results/ [--folds 5]
    python -m gridrisk.cli safety --panel grid_day.csv --out results/ [--geojson cells.geojson]

Input CSVs are read with an explicit schema built from their header (text ids
as STRING, everything else DOUBLE); parquet is read as is.  Every result table
is written as a directory (parquet, or CSV with ``--csv``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .plans import registry, workflows
from .session import get_session
from .sources import io


def _read(spark, path: str):
    if path.endswith(".csv"):
        header = spark.read.option("header", True).csv(path).columns  # reads the first line only
        return io.read_panel(spark, path, schema=registry.panel_schema(header), fmt="csv")
    return io.read_panel(spark, path)


def _specs(text: str):
    out = []
    for part in text.split(","):
        tr, te = part.split(":")
        a, b = tr.split("-")
        c, d = te.split("-")
        out.append({"train": (int(a), int(b)), "test": (int(c), int(d))})
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="gridrisk")
    ap.add_argument("analysis", choices=["risk", "volume", "safety"])
    ap.add_argument("--panel", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--csv", action="store_true", help="write CSV instead of parquet")
    ap.add_argument("--exclude", default="", help="cells left out (comma list; 'study' for the study's own)")
    ap.add_argument("--specs", default=registry.STUDY_SPECS, help="train-test week ranges per split")
    ap.add_argument("--folds", type=int, default=None, help="volume: whole-site folds (default leave-one-out)")
    ap.add_argument("--keep", type=int, default=30, help="volume: features kept by elimination")
    ap.add_argument("--geojson", default=None)
    ap.add_argument("--geojson-seq", action="store_true", help="the GeoJSON has one feature per line")
    a = ap.parse_args(argv)

    spark = get_session(a.master)
    fmt = "csv" if a.csv else "parquet"
    exclude = list(registry.STUDY_EXCLUDED_CELLS) if a.exclude == "study" else [int(x) for x in a.exclude.split(",") if x]
    panel = _read(spark, a.panel)
    if a.analysis == "risk":
        panel = panel.withColumn("Date", F.to_date("Date"))
        feats = [c for c in registry.group_list(registry.STAGE2_GROUPS, list(registry.STAGE2_GROUPS))
                 if c in panel.columns]
        out = workflows.risk_model(panel, specs=_specs(a.specs), feature_cols=feats, date="Date",
                                   exposure="Predicted Daily Count", exclude=exclude,
                                   classifier_grid=registry.FOREST_GRID, regressor_grid=registry.FOREST_GRID,
                                   write_back_split=2, map_from_week=27)
    elif a.analysis == "volume":
        prepared = workflows.prepare_count_panel(panel)
        feats = [c for c in registry.group_list(registry.STAGE1_GROUPS, registry.STAGE1_SELECTION)
                 if c in prepared.columns]
        out = workflows.volume_model(prepared, site="grid", date="Date", target="Daily Count",
                                     feature_cols=feats, exclude=exclude, keep=a.keep, folds=a.folds,
                                     search_grid=registry.FOREST_SEARCH)
    else:
        panel = panel.withColumn("Date", F.to_date("Date"))
        geo = io.read_geojson(spark, a.geojson, seq=a.geojson_seq) if a.geojson else None
        feats = [c for c in registry.SAFETY_PREDICTORS if c in panel.columns]
        out = workflows.safety_in_numbers(panel, date="Date", exposure="Predicted Daily Count", feature_cols=feats, geo=geo)
    for name, df in out.items():
        if "geometry" in df.columns and fmt == "csv":
            df = df.withColumn("geometry", F.to_json("geometry"))
        io.write_table(df, f"{a.out}/{name}", fmt=fmt)
        print(f"wrote {a.out}/{name}")
    spark.stop()


if __name__ == "__main__":
    main()
