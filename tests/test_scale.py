import json
import random

import pytest
from pyspark.sql import functions as F

from gridrisk.operators import clean, features, panel, sketch
from gridrisk.sources import geojson
from gridrisk.sources.io import metrics_long, read_geojson, write_weeks, z_order


def collection(n, seed=1, order=("type", "properties", "geometry"), indent=None):
    rng, out = random.Random(seed), []
    for i in range(n):
        f = {"type": "Feature", "properties": {"grid": i, "name": rng.choice(['plain', 'b{r}ace', 'quo"te', '"Feature"', 'back\\', 'é漢{', '}{'])},
             "geometry": rng.choice([None, {"type": "Polygon", "coordinates": [[[rng.random(), 1.5]] * rng.randint(1, 9)]}])}
        out.append({k: f[k] for k in order})
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": out}


@pytest.mark.parametrize("order,indent", [(("type", "properties", "geometry"), None), (("geometry", "properties", "type"), None), (("properties", "type", "geometry"), 2)])
def test_every_way_to_cut_a_collection(order, indent, monkeypatch):
    monkeypatch.setattr(geojson, "READ_BYTES", 64)
    made = collection(25, order=order)
    body = json.dumps(made, indent=indent, ensure_ascii=False).encode()
    read = lambda at, n: body[at:at + n]
    for split in (len(body), 1000, 333, 97, 20):
        got = [f for a in range(0, len(body), split) for f in geojson.features(read, a, min(a + split, len(body)), len(body))]
        assert got == made["features"], split


def test_collection_in_several_tasks(spark, tmp_path):
    path = tmp_path / "layer.geojson"
    made = collection(3000)
    path.write_text(json.dumps(made, ensure_ascii=False))
    ddl = "type string, properties struct<grid: bigint, name: string>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    df = read_geojson(spark, str(path), feature_schema=ddl, split_bytes=20_000)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["grid"] for r in rows) == list(range(3000)) and len({r["task"] for r in rows}) > 3
    whole = read_geojson(spark, str(path), feature_schema=ddl)
    assert whole.exceptAll(df).count() == 0 and df.exceptAll(whole).count() == 0
    with pytest.raises(ValueError):
        read_geojson(spark, str(path), split_bytes=10)


def test_dictionary_of_many_levels(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 1000 != 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("c"))
    out, n = clean.encode(df, "c", "index")
    rows = {r["id"]: r["index"] for r in out.collect()}
    levels = sorted(f"v{i}" for i in range(100_000) if i % 1000)
    assert n == len(levels) and all(rows[int(v[1:])] == k for k, v in enumerate(levels) if k % 997 == 0) and rows[1000] is None
    vec = clean.one_hot_vector(df, ["c"]).where("id in (0, 1, 10, 99999)").collect()
    for r in vec:
        v, at = r["c_vec"], levels.index(f"v{r['id']}") - 1 if r["id"] else -1
        assert v.size == n - 1 and list(v.indices) == ([at] if at >= 0 else [])


def test_one_hot_vector_small(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    full = {r["c"]: r["v"] for r in df.join(clean.one_hot_vector(df.withColumn("k", F.col("c")), ["c"], drop_first=False)
                                           .select("k", F.col("c_vec").alias("v")), F.col("c").eqNullSafe(F.col("k"))).collect()}
    assert [list(full[k].toArray()) for k in ("a", "b", "c", None)] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]]
    cut = [list(r["c_vec"].toArray()) for r in clean.one_hot_vector(df, ["c"]).collect()]
    assert sorted(cut) == [[0, 0], [0, 0], [0, 1], [1, 0]]


def test_levels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(clean, "MAX_LEVELS", 5)
    with pytest.raises(ValueError):
        clean.one_hot(spark.range(9).select(F.col("id").cast("string").alias("c")), ["c"])


def test_tables_of_days_and_keys(spark):
    df = spark.createDataFrame([("2023-01-01", 1), ("2023-01-02", None), (None, 2)], "date string, k int")
    days = spark.createDataFrame([("2023-01-01",), ("2023-01-01",), (None,)], "day string")
    assert [r["is_holiday"] for r in features.flag_days(df, "date", days, "day").orderBy(F.desc_nulls_last("date")).collect()] == [0, 1, 0]
    listed = spark.createDataFrame([(2,), (2,)], "k int")
    assert panel.exclude_listed(df, "k", listed).count() == 2
    assert panel.exclude_listed(df, "k", spark.createDataFrame([(None,)], "k int")).count() == 2


def test_metrics_with_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "id int, `it's` double, `a b` int")
    assert [tuple(r) for r in metrics_long(df, ["id"]).collect()] == [(1, "it's", 2.0), (1, "a b", 3.0)]


def test_one_week_written_again(spark, tmp_path):
    path = str(tmp_path / "layer")
    df = spark.range(2000).select("id", (F.col("id") % 4).cast("int").alias("week"), (F.col("id") % 360 - 180.0).alias("lon"), (F.col("id") % 170 - 85.0).alias("lat"))
    write_weeks(df, path, near=("lon", "lat"))
    before = {f for f in spark.read.parquet(path).where("week <> 2").inputFiles() if "week=2" not in f}
    write_weeks(df.where("week = 2").withColumn("id", -F.col("id")), path, near=("lon", "lat"))
    after = spark.read.parquet(path)
    assert before <= set(after.inputFiles()) and after.count() == 2000
    assert after.where("week = 2 and id > 0").count() == 0 and after.where("week <> 2 and id < 0").count() == 0


def test_z_order(spark):
    got = {(r["x"], r["y"]): r["z"] for r in spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
           .withColumn("z", z_order(F.col("x") / 3.0, F.col("y") / 3.0, bits=2)).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[0, 1] == 2 and got[1, 1] == 3 and got[3, 3] == 15 and len(set(got.values())) == 16


def test_sketches_merge_as_if_whole(spark):
    df = spark.range(40_000).select((F.col("id") % 5).alias("k"), (F.col("id") % 2000).alias("d"), F.sqrt("id").alias("x"), F.pmod("id", F.lit(50)).alias("day"))
    stored = sketch.sketches(df, ["k", "day"], "d", "x")
    for r in sketch.estimates(sketch.merge(stored, ["k"])).collect():
        exact = df.where(F.col("k") == r["k"]).agg(F.count_distinct("d").alias("d"), F.avg((F.col("x") <= r["q_0.5"]).cast("int")).alias("rank")).first()
        assert r["n"] == 8000 and abs(r["n_distinct"] / exact["d"] - 1) < 0.08 and abs(exact["rank"] - 0.5) < 0.03


def test_a_small_panel_is_read_by_few_tasks(spark):
    """The shuffle partitions of a large table cost a small panel's fits a task each, in every job and shuffle."""
    from gridrisk import session

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = session.materialize(spark.range(5000).selectExpr("id", "id % 7 AS k"))
        assert got.rdd.getNumPartitions() == session.tasks_for(spark, 5000) == 2 * spark.sparkContext.defaultParallelism < 64
        assert sorted(r.id for r in got.collect()) == list(range(5000))
        assert session.materialize(spark.range(9), 33).rdd.getNumPartitions() == 33
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert session.tasks_for(spark, 100 * session.TASK_ROWS + 1) == 101


def test_fits_read_rows_kept_in_memory(spark):
    from gridrisk.operators import learn
    from gridrisk.session import materialize

    df = materialize(spark.range(60).selectExpr("id", "CAST(id % 7 AS double) AS a", "CAST(id % 5 AS double) AS y"))
    plain = learn.assemble(df, ["a"])
    with learn.fit_input(df, ["a"]) as a:
        assert a.storageLevel.useMemory and a.storageLevel.useDisk
        assert [x.collect() for x in (a.where("id > 9"),)] == [plain.where("id > 9").collect()]
        assert a.rdd.getNumPartitions() == plain.rdd.getNumPartitions()
        fits = [learn.forest("y", numTrees=3).fit(x).toDebugString for x in (a, plain)]
        assert fits[0].split("\n")[1:] == fits[1].split("\n")[1:]
    assert not a.storageLevel.useMemory
