import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridrisk.operators import clean, ranking, scaling, split


def test_interpolate_fixture(spark):
    """FIXTURES 2.4: [null,1,null,3,null] -> [1,1,2,3,3]; all-null stays null."""
    data = [("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])] + \
           [("b", i, None) for i in range(3)]
    df = spark.createDataFrame(data, "s string, t int, v double")
    out = clean.interpolate(df, ["v"], ["t"], ["s"]).orderBy("s", "t").collect()
    assert [r.v for r in out] == [1.0, 1.0, 2.0, 3.0, 3.0, None, None, None]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_interpolate_matches_pandas(spark, block):
    rnd = random.Random(block)
    data = []
    for s in ["x", "y", "z"]:
        n = rnd.randint(5, 40)
        for t in range(n):
            data.append((s, t, None if rnd.random() < 0.45 else rnd.uniform(-5, 5),
                         None if rnd.random() < 0.3 else float(t)))
    df = spark.createDataFrame(data, "s string, t int, v double, w double")
    got = clean.interpolate(df, ["v", "w"], ["t"], ["s"], block_rows=block).toPandas()
    got = got.sort_values(["s", "t"]).reset_index(drop=True)
    pdf = pd.DataFrame(data, columns=["s", "t", "v", "w"]).sort_values(["s", "t"]).reset_index(drop=True)
    for c in ["v", "w"]:
        exp = pdf.groupby("s")[c].transform(lambda x: x.interpolate(method="linear", limit_direction="both"))
        np.testing.assert_allclose(got[c].astype(float).values, exp.astype(float).values, equal_nan=True)


def test_interpolate_no_partition_is_file_order(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, None), (4, 8.0)], "t int, v double")
    assert [r.v for r in clean.interpolate(df, ["v"], ["t"], block_rows=2).orderBy("t").collect()] == \
        [2.0, 2.0, 4.0, 6.0, 8.0]


def test_row_number_and_ntile(spark):
    df = spark.range(0, 1003).select((F.col("id") * 7919 % 1003).alias("k"), (F.col("id") % 3).alias("g"))
    rn = ranking.row_number_global(df, ["k"], partitions=7)
    assert sorted(r.rn for r in rn.collect()) == list(range(1, 1004))
    assert rn.where(F.col("rn") != F.col("k") + 1).count() == 0
    got = {r.k: r.tile for r in ranking.ntile_global(df, 3, ["k"], partitions=5).collect()}
    ref = {r.k: r.t for r in df.select("k", (F.ntile(3).over(Window.orderBy("k")) - 1).alias("t")).collect()}
    assert got == ref
    within = ranking.rank_within(df, ["g"], ["k"], partitions=4)
    ref2 = df.select("g", "k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).alias("p"))
    assert within.join(ref2, ["g", "k"]).where(F.col("pos") != F.col("p")).count() == 0


def test_ntile_remainder_rule(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    tiles = [r.fold for r in split.fold_id(df, 3, ["k"]).orderBy("k").collect()]
    assert tiles == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_scaling_edges(spark):
    """FIXTURES 2.5: constant group -> 0; single row -> 0; unseen group -> global stats."""
    df = spark.createDataFrame([("c", 5.0), ("c", 5.0), ("one", 3.0), ("v", 1.0), ("v", 3.0)], "g string, x double")
    out = {(r.g, r.x): r.scaled for r in scaling.standardize(df, "g", "x").collect()}
    assert out[("c", 5.0)] == 0.0 and out[("one", 3.0)] == 0.0
    assert out[("v", 1.0)] == -1.0 and out[("v", 3.0)] == 1.0
    train = df.where("g != 'v'")
    st, gl = scaling.fit_scaler(train, "g", "x"), scaling.fit_global(train, "x")
    z = scaling.standardize(df, "g", "x", stats=st, global_stats=gl)
    g_mean, g_std = np.mean([5, 5, 3]), np.std([5, 5, 3])
    zv = {r.x: r.scaled for r in z.where("g = 'v'").collect()}
    assert zv[1.0] == pytest.approx((1 - g_mean) / g_std)
    back = scaling.unstandardize(z, st, "g", "scaled", out="x_back", global_stats=gl)
    assert back.where(F.abs(F.col("x") - F.col("x_back")) > 1e-9).count() == 0


def test_temporal_splits(spark):
    """FIXTURES 2.9: overlapping and gapped specs; week 53 in none."""
    df = spark.createDataFrame([(w,) for w in [1, 23, 24, 26, 27, 52, 53]], "week int")
    specs = [{"train": (1, 23), "test": (27, 52)}, {"train": (1, 26), "test": (27, 52)}]
    out = sorted((r.split, r.role, r.week) for r in split.temporal_splits(df, specs).collect())
    assert (1, "train", 24) not in out and (2, "train", 24) in out
    assert all(w != 53 for _, _, w in out)
    assert len(out) == 2 + 4 + 2 * 2


def test_logo_and_group_folds(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4), ("solo", 5)], "g string, v int")
    f = {r.g: r.fold for r in split.logo_folds(df, "g").collect()}
    assert f == {"a": 0, "b": 1, "c": 2, "solo": 3}
    h = split.group_kfold(df, "g", 2).collect()
    per = {}
    for r in h:
        per.setdefault(r.g, set()).add(r.fold)
    assert all(len(v) == 1 for v in per.values())


def test_stratified_fold_ids(spark):
    labels = [0] * 10 + [1] * 5
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate([0, 1] * 5 + [0] * 5)], "i int, y int")
    got = {r.i: r.fold for r in split.fold_id(df, 3, ["i"], label="y").collect()}
    zero = [i for i in sorted(got) if i in {r.i for r in df.where("y = 0").collect()}]
    assert [got[i] for i in zero] == [0] * 4 + [1] * 3 + [2] * 3
    one = [i for i in sorted(got) if i not in zero]
    assert [got[i] for i in one] == [0, 1, 1, 2, 2]
    assert len(labels) == len(got)


def test_hot_group_is_split_across_tasks(spark):
    """A group holding a third of the rows is numbered by several tasks, and the
    per-group positions stay exact."""
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
                               (F.col("id") * 7 % n).alias("x"))
    numbered = ranking.row_number_global(df, ["g", "x"], "rn", partitions=8)
    hot = numbered.where("g = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    r = ranking.rank_within(df, ["g"], ["x"], partitions=8)
    assert len(hot) >= 2 and max(c["count"] for c in hot) < n // 3
    ref = df.select("g", "x", (F.row_number().over(Window.partitionBy("g").orderBy("x")) - 1).alias("p"))
    assert r.join(ref, ["g", "x"]).where(F.col("pos") != F.col("p")).count() == 0
    sk = spark.createDataFrame([(0 if i % 3 == 0 else i % 7, float(i % 11) if i % 4 else None) for i in range(600)],
                               "g int, v double").withColumn("t", F.monotonically_increasing_id())
    out = clean.interpolate(sk, ["v"], ["t"], ["g"], block_rows=16)
    assert out.count() == 600 and out.where(F.col("v").isNull()).count() == 0


def test_out_of_fold_statistics(spark):
    rows = [(f, float(v)) for f, vals in enumerate([[1, 2, 3], [10, 20], [5]]) for v in vals]
    df = spark.createDataFrame(rows, "fold int, x double")
    got = {r.fold: (r.mean, r.scale) for r in scaling.fit_out_of_fold(df, "fold", "x").collect()}
    for f in range(3):
        rest = np.array([v for ff, v in rows if ff != f])
        assert got[f][0] == pytest.approx(rest.mean())
        assert got[f][1] == pytest.approx(rest.std() if rest.std() > 0 else 1.0)
