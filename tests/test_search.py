import pytest
from pyspark.sql import functions as F

from gridrisk.operators import learn, search
from gridrisk.session import materialize


def frame(spark, n=240):
    df = spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") * 13) % 5).cast("double").alias("b"),
                               ((F.col("id") * 31) % 11).cast("double").alias("c"), (F.col("id") % 3).cast("int").alias("fold"))
    return materialize(df.withColumn("y", F.col("a") * 2 + F.col("b")))


def test_scores_equal_serial_fits(spark):
    a = learn.assemble(frame(spark), ["a", "b"])
    est, ev = learn.forest("y", numTrees=3), learn.regression_evaluator("y", "mae")
    got = learn.grid_search(a, est, {"maxDepth": [1, 4]}, ev, fold="fold")
    for m, row in zip(got.maps, got.scores, strict=True):
        for k, s in zip(got.folds, row, strict=True):
            model = est.copy(m).fit(a.where(F.col("fold") != k))
            assert s == pytest.approx(ev.evaluate(model.transform(a.where(F.col("fold") == k))), abs=1e-9)
    assert got.best == 1 and got.bestModel.getNumTrees == 3
    assert got.table(spark).count() == 6 and len(learn.cv_table(got)) == 2


class Broken(Exception):
    pass


def test_a_killed_run_goes_on(spark, tmp_path):
    path, ran = str(tmp_path / "ledger"), []

    def job(k, fail):
        ran.append(k)
        if fail:
            raise Broken
        return {"k": k}

    with pytest.raises(Broken):
        search.run_kept(spark, {str(k): lambda k=k: job(k, k == 2) for k in range(4)}, path, width=1)
    assert sorted(ran) == [0, 1, 2, 3]
    ran.clear()
    got = search.run_kept(spark, {str(k): lambda k=k: job(k, False) for k in range(5)}, path, width=3)
    assert sorted(ran) == [2, 4] and got == {str(k): {"k": k} for k in range(5)}


def test_folds_are_kept(spark, tmp_path, monkeypatch):
    a = learn.assemble(frame(spark), ["a", "b"])
    est, path = learn.linear("y"), str(tmp_path / "folds")
    first = learn.cross_predict(a, est, "fold", path=path)
    assert first.count() == 240 and first.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-6
    monkeypatch.setattr(type(est), "fit", lambda *a: (_ for _ in ()).throw(Broken()))
    assert learn.cross_predict(a, est, "fold", path=path).count() == 240


def test_elimination_goes_on_from_its_steps(spark, tmp_path):
    df, path, fits = frame(spark), str(tmp_path / "rfecv"), []

    def make(limit):
        def factory(label, column):
            fits.append(column)
            if len(fits) > limit:
                raise Broken
            return learn.forest(label, column, numTrees=3, maxDepth=4)
        return factory

    whole = learn.rfecv(df, ["a", "b", "c"], "y", "fold", est_factory=make(10 ** 6))
    fits.clear()
    with pytest.raises(Broken):
        learn.rfecv(df, ["a", "b", "c"], "y", "fold", est_factory=make(5), path=path, width=1)
    fits.clear()
    assert learn.rfecv(df, ["a", "b", "c"], "y", "fold", est_factory=make(10 ** 6), path=path) == whole
    assert len(fits) < 9 + 3  # not all of the first run's steps again


def test_jobs_keep_their_order_and_raise(spark):
    assert search.side_by_side(spark, [lambda i=i: i * i for i in range(9)], width=4) == [i * i for i in range(9)]
    with pytest.raises(Broken):
        search.side_by_side(spark, [lambda: 1, lambda: (_ for _ in ()).throw(Broken())])
