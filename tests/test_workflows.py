"""Workflow chains on small hand-made panels shaped like the study's inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridrisk.plans import registry, workflows


@pytest.fixture(scope="module")
def site_days(spark):
    rnd = random.Random(4)
    rows = []
    for g in (1, 2, 3, 4):
        for i in range(60):
            d = dt.date(2023, 1, 1) + dt.timedelta(days=i)
            rows.append(("SG%02d" % g, "SG" if g != 4 else "XX", g, d.isoformat(),
                         float(100 * g + 10 * (d.weekday() >= 5) + rnd.random()),
                         "Camden" if g % 2 else "Islington", "n%d" % g,
                         None if i % 7 == 3 else float(5 + rnd.random()),
                         rnd.choice(["20 mph", "30mph", "none"]), rnd.choice(["none", "track"])))
    return spark.createDataFrame(rows, "SiteID string, GroupType string, grid long, Date string, `Daily Count` double, "
                                       "Borough string, Names string, tavg double, max_speed string, cycleway_type string")


def test_prepare_count_panel(spark, site_days):
    p = workflows.prepare_count_panel(site_days)
    assert p.where("GroupType != 'SG'").count() == 0
    assert {"Borough_Islington", "Names_n2", "Names_n3", "season_winter", "is_holiday", "weekend"} <= set(p.columns)
    assert "Borough" not in p.columns
    assert p.where(F.col("tavg").isNull()).count() == 0
    assert {r.max_speed for r in p.select("max_speed").distinct().collect()} <= {0.0, 20.0, 30.0}  # unparseable -> NULL -> 0 (fill)
    assert p.where("cycleway_type = 'none'").count() == 0
    assert p.where("Date = DATE'2023-01-01'").first().is_holiday == 1


def test_volume_model_leak_free(spark, site_days):
    p = workflows.prepare_count_panel(site_days)
    feats = ["day_of_week", "weekend", "tavg", "max_speed"]
    out = workflows.volume_model(p, site="grid", date="Date", target="Daily Count", feature_cols=feats,
                                 forest_params={"numTrees": 5, "maxDepth": 3}, explain_model=False)
    per = out["per_group"].collect()
    assert len(per) == 3 and all(r.n == 60 for r in per)
    assert out["predictions"].count() == 180
    compat = workflows.volume_model(p, site="grid", date="Date", target="Daily Count", feature_cols=feats,
                                    forest_params={"numTrees": 5, "maxDepth": 3}, explain_model=False,
                                    leak_free=False)
    # the held-out site's own statistics make the reference form look better
    assert compat["pooled"].first().pooled_mae < out["pooled"].first().pooled_mae


def test_registry_group_sizes():
    assert len(registry.group_list(registry.STAGE2_GROUPS, list(registry.STAGE2_GROUPS))) == 60
    both = {**registry.STAGE2_GROUPS, **registry.COMPARISON_EXTRA_GROUPS}
    assert len(registry.group_list(both, registry.COMPARISON_SELECTION)) == 81
    assert len(registry.group_list(registry.STAGE1_GROUPS, registry.STAGE1_SELECTION)) == 99
    sch = registry.panel_schema(["grid", "Date", "Aged 65+_2013"])
    assert [f.dataType.simpleString() for f in sch.fields] == ["bigint", "string", "double"]


def test_cli_risk_on_csv(spark, tmp_path):
    rnd = random.Random(1)
    lines = ["grid,Date,accident,Predicted Daily Count,tavg,HECTARES"]
    for g in (1, 2, 138):
        for i in range(0, 120):
            d = dt.date(2023, 1, 2) + dt.timedelta(days=i)
            lines.append(f"{g},{d},{int(rnd.random() < 0.1)},{rnd.randint(0, 50)},{rnd.random():.3f},{g * 1.5}")
    src = tmp_path / "panel.csv"
    src.write_text("\n".join(lines) + "\n")
    from gridrisk import cli
    out = tmp_path / "out"
    # the CLI stops the session it gets; give it its own by running in a subprocess
    import subprocess, sys, os
    code = subprocess.run([sys.executable, "-m", "gridrisk.cli", "safety", "--panel", str(src), "--out", str(out),
                           "--master", "local[2]"], cwd=os.path.dirname(os.path.dirname(__file__)),
                          capture_output=True, text=True, timeout=600)
    assert code.returncode == 0, code.stderr[-2000:]
    assert (out / "surface").exists() and (out / "ols").exists()
    assert cli is not None


def test_risk_model_coerces_text_features(spark):
    """A speed written as text has no number where it has a unit: NULL, filled with the mean like any gap."""
    from pyspark.sql import functions as F

    from gridrisk.plans.workflows import risk_model
    days = spark.range(6 * 140).select((F.col("id") % 6).cast("int").alias("grid"), F.date_add(F.lit("2023-01-02").cast("date"), F.floor(F.col("id") / 6).cast("int")).alias("date"),
                                       (F.col("id") % 7 == 0).cast("int").alias("accident"), (F.col("id") % 11 + 1).cast("double").alias("exposure"),
                                       F.when(F.col("id") % 5 == 0, "30 mph").otherwise((F.col("id") % 3 * 10).cast("string")).alias("max_speed"))
    out = risk_model(days, specs=[{"train": (1, 12), "test": (13, 20)}], feature_cols=["max_speed"], forest_params={"numTrees": 2, "maxDepth": 3})
    assert out["metrics"].count() > 5 and dict(out["weekly"].dtypes)["max_speed"] == "double"
