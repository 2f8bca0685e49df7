"""NULL keys, ties and sizes that once were caps: no row is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.operators import clean, evaluate, learn, ranking, risk, split, stats


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(None, 1, 1.0), (None, 2, None), (None, 3, 3.0), ("a", 1, None), ("a", 2, 5.0)],
                                 "g string, t int, v double")


def test_interpolate_keeps_null_partitions(five):
    got = sorted((r.g or "", r.t, r.v) for r in clean.interpolate(five, ["v"], ["t"], ["g"], block_rows=1).collect())
    assert got == [("", 1, 1.0), ("", 2, 2.0), ("", 3, 3.0), ("a", 1, 5.0), ("a", 2, 5.0)]


def test_carry_in_levels(spark, monkeypatch):
    monkeypatch.setattr(clean, "CARRY_BLOCKS", 3)
    vals = [None] * 7 + [1.0] + [None] * 20 + [22.0] + [None] * 11
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "t int, v double")
    got = [r.v for r in clean.interpolate(df, ["v"], ["t"], block_rows=2).orderBy("t").collect()]
    assert got == [1.0] * 8 + [2.0 + i for i in range(20)] + [22.0] * 12


def test_folds_keep_null_groups(five):
    assert sorted(r.fold for r in split.logo_folds(five, "g").collect()) == [0, 0, 0, 1, 1]
    assert split.fold_id(five, 2, ["t", "v"], label="g").count() == 5


def test_group_folds_are_never_empty(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(5)] * 3, "g string")
    assert {r.fold for r in split.group_kfold(df, "g", 5).collect()} == set(range(5))


def test_stratified_folds_follow_round_robin(spark):
    # label-sorted rows 0*10 + 1*5 dealt into 3 slices: class 0 -> 4,3,3; class 1 -> 1,2,2
    df = spark.createDataFrame([(i, 0 if i < 10 else 1) for i in range(15)], "i int, y int")
    got = split.fold_id(df, 3, ["i"], label="y").groupBy("y", "fold").count().collect()
    assert {(r.y, r.fold): r["count"] for r in got} == {(0, 0): 4, (0, 1): 3, (0, 2): 3, (1, 0): 1, (1, 1): 2, (1, 2): 2}


def test_box_stats_null_group_and_ties(spark):
    rows = [(None, 1.0), (None, 3.0)] + [("hot", 0.0)] * 800 + [("hot", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in stats.box_stats(df, "g", "x").collect()}
    x = np.array([v for g, v in rows if g == "hot"])
    q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert (got["hot"].q1, got["hot"].median, got["hot"].q3) == (q1, med, q3)
    assert got["hot"].n_outliers == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    assert got[None].median == 2.0 and got[None].n == 2 and {r.label for r in got.values()} == {1, 2}


def test_running_total_spreads_a_hot_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), "id", (F.col("id") % 3).alias("w"))
    out = ranking.running_total(df, ["g", "id"], "w", "before", partitions=8)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert [r.before for r in out.orderBy("id").limit(5).collect()] == [0, 0, 1, 3, 3]


def test_confusion_over_all_classes(spark):
    df = spark.createDataFrame([(0, 1.0), (2, 2.0), (2, 0.0), (1, 1.0)], "y int, p double")
    got = {(r.label, r.prediction): r.n for r in stats.confusion(df, "y", "p").collect()}
    assert sum(got.values()) == 4 and len(got) == 9 and got[2, 2] == 1 and got[0, 0] == 0
    for bad in ([(None, 1.0)], [(0, 0.5)]):
        with pytest.raises(Exception, match="no class"):
            stats.confusion(spark.createDataFrame(bad, "y int, p double"), "y", "p").collect()


def test_one_hot_vector(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, c string")
    got = {r.id: r.c_vec.toArray().tolist() for r in clean.one_hot_vector(df, ["c"]).collect()}
    assert got == {1: [0, 0], 2: [1, 0], 3: [0, 0], 4: [0, 1]}


def test_logo_linear_null_group_and_many_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 40))
    y = x @ rng.normal(size=40) + 1
    groups = [None if i % 3 == 0 else i % 3 for i in range(90)]
    names = [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([(g, float(b), *map(float, a)) for g, a, b in zip(groups, x, y, strict=True)],
                               "g int, y double, " + ", ".join(f"{n} double" for n in names))
    got = learn.logo_linear(df, names, "y", "g").select("y", "prediction").collect()
    assert len(got) == 90 and all(abs(r.y - r.prediction) < 1e-6 for r in got)


def test_gram_of_many_columns(spark):
    x = np.random.default_rng(2).normal(size=(50, 60))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(60)))
    assert np.allclose(stats.gram(df.repartition(4), df.columns), x.T @ x)


def test_tree_depth():
    assert learn.tree_depth(None) == 30 and learn.tree_depth(7) == 7
    with pytest.raises(ValueError):
        learn.tree_depth(31)


def test_map_layer_bounds_cover_every_week(spark):
    w = spark.createDataFrame([(1, 2020, 10, 9.0, None), (1, 2020, 30, 1.0, 2.0), (1, 2020, 45, 3.0, 2.5)],
                              "grid int, year int, week int, actual double, predicted double")
    got = risk.map_layer(w, min_week=40).collect()
    assert [(r.week, r.vmin, r.vmax) for r in got] == [(45, 1.0, 9.0)]


def test_threshold_metrics(spark):
    df = spark.createDataFrame([(0.0, 2.0), (3.0, 2.0), (3.0, 0.0), (0.0, 0.0)], "y double, p double")
    r = evaluate.threshold_metrics(df, "y", "p", 1.0).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5) and r.n_nonzero == 2
