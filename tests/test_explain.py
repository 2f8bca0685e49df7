import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.functions import permute
from gridrisk.operators import explain, forest, learn


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation_columns_equal_the_plain_form(spark, n):
    keys = permute.round_keys(42, 5)
    df = permute.with_image(spark.range(n), "id", n, permute.key_column(keys), "to")
    got = [r["to"] for r in df.orderBy("id").select("to").collect()]
    assert got == [permute.image(i, n, keys) for i in range(n)]
    assert sorted(got) == list(range(n))


def test_donors_of_a_periodic_column_are_spread():
    """Places of one weekday get donors of all seven, in every repeat, as often as chance has it."""
    n = 3500
    for number in range(10):
        keys = permute.round_keys(1, number)
        counts = np.zeros((7, 7))
        for i in range(n):
            counts[i % 7, permute.image(i, n, keys) % 7] += 1
        chi = ((counts - n / 49) ** 2 / (n / 49)).sum()
        assert chi < 80  # 36 degrees of freedom: beyond 1 in 10,000


def test_images_are_uniform_and_keys_differ():
    n = 1009
    maps = [[permute.image(i, n, permute.round_keys(3, k)) for i in range(n)] for k in range(40)]
    assert len({tuple(m) for m in maps}) == 40
    for place in (0, 1, 500, 1008):  # where one place goes under many keys
        assert len({m[place] for m in maps}) > 35
    steps = [(m[i + 1] - m[i]) % n for m in maps for i in range(n - 1)]
    assert np.bincount(steps, minlength=n).max() < 100  # no constant stride, as an affine map has


def frame(spark, n=400):
    return spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") * 13) % 5).cast("double").alias("b"),
                                 ((F.col("id") * 7919) % 101 / 10).alias("c")).withColumn("y", F.col("a") * 2 + F.col("b") * F.col("b") + F.col("c"))


def test_variants_move_blocks_by_their_own_permutations(spark):
    df = frame(spark)
    blocks = {"ab": ["a", "b"], "c": ["c"], "a": ["a"]}
    rows = explain.permuted_variants(df, ["id"], blocks, 2, 9).collect()
    assert len(rows) == 400 * 6
    src = {r["id"]: r for r in df.collect()}
    for i, (name, cols) in enumerate(blocks.items()):
        for rep in range(2):
            got = {r["id"]: r for r in rows if r["_pv_block"] == name and r["_pv_rep"] == rep}
            keys = permute.round_keys(9, i * 2 + rep)
            for donor in range(400):
                to = permute.image(donor, 400, keys)
                for c in ("a", "b", "c"):
                    assert got[to][c] == src[donor if c in cols else to][c]


def brute_dependence(nodes, features, target, value):
    total, at = 0.0, {(r["tree"], r["node"]): r for r in nodes}

    def walk(r, share):
        if r["left"] < 0:
            return share * r["prediction"] * r["weight"]
        left, right = at[r["tree"], r["left"]], at[r["tree"], r["right"]]
        if features[r["feature"]] == target:
            return walk(left if value <= r["threshold"] else right, share)
        return walk(left, share * left["n"] / r["n"]) + walk(right, share * right["n"] / r["n"])

    for (_, node), r in at.items():
        if node == 0:
            total += walk(r, 1.0)
    return total


@pytest.mark.parametrize("make", [lambda: learn.forest("y", numTrees=5, maxDepth=6), lambda: learn.gbt("y", maxIter=4, maxDepth=3)])
def test_dependence_by_the_trees_equals_a_walk(spark, make):
    feats = ["a", "b", "c"]
    df = frame(spark)
    model = make().fit(learn.assemble(df, feats))
    table = forest.node_table(spark, model)
    grid = explain.dependence_grid(df, feats, points=20)
    assert grid["a"] == [float(i) for i in range(7)] and len(grid["c"]) == 20
    nodes = table.collect()
    got = explain.tree_dependence(table, feats, grid).collect()
    assert len(got) == 7 + 5 + 20
    for r in got:
        assert abs(r["mean_prediction"] - brute_dependence(nodes, feats, r["feature"], r["value"])) < 1e-9


def test_both_forms_agree_where_columns_are_independent(spark):
    df = spark.range(35 * 20).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * F.col("a") + F.col("b"))
    model = learn.forest("y", numTrees=1, maxDepth=8, bootstrap=False).fit(learn.assemble(df, ["a", "b"]))
    grid = explain.dependence_grid(df, ["a"])
    by_trees = {r["value"]: r["mean_prediction"] for r in explain.tree_dependence(forest.node_table(spark, model), ["a", "b"], grid).collect()}
    by_rows = {r["value"]: r["mean_prediction"] for r in explain.partial_dependence(df, model, ["a", "b"], ["a"]).collect()}
    assert by_trees.keys() == by_rows.keys() and all(abs(by_trees[v] - by_rows[v]) < 1e-9 for v in by_rows)


def test_node_importance_equals_the_models(spark):
    feats = ["a", "b", "c"]
    df = frame(spark)
    model = learn.forest("y", numTrees=4, maxDepth=5).fit(learn.assemble(df, feats))
    got = {r["feature"]: r["importance"] for r in forest.node_importance(forest.node_table(spark, model), feats).collect()}
    for f, v in zip(feats, model.featureImportances.toArray(), strict=True):
        assert abs(got[f] - v) < 1e-9


def test_a_tree_of_one_leaf(spark):
    df = frame(spark).withColumn("y", F.lit(3.0))
    model = learn.forest("y", numTrees=2, maxDepth=3).fit(learn.assemble(df, ["a", "b"]))
    table = forest.node_table(spark, model)
    assert {r["mean_prediction"] for r in explain.tree_dependence(table, ["a", "b"], {"a": [0.0, 5.0]}).collect()} == {3.0}
    assert [r["importance"] for r in forest.node_importance(table, ["a", "b"]).collect()] == [0.0, 0.0]
