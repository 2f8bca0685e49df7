"""Explanation queries with SQL: the permutations' donor map, and a small tree whose node table,
importances and partial dependence SQL can say.

The tree is the forest of one unsampled tree of two levels on calendar columns.  The label is a count and
the columns have at most 31 values, so every sum is exact and every midpoint is a candidate split, in
MLlib and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import permute
from ..operators import explain, features, forest, learn
from ..operators.ranking import number_rows
from ..session import cut_lineage, materialize
from . import bindings as B
from .catalog import query, round_doubles
from .oracle import with_views

# ------------------------------------------------------------------ permutations ---

DONOR_BLOCKS, DONOR_REPEATS, DONOR_SEED = ("calendar", "price"), 2, 42


def _donor_sql() -> str:
    """Ranks by (site, date); every permutation's rounds, and the walk of places that land behind n."""
    rows = []
    for i, block in enumerate(DONOR_BLOCKS):
        for r in range(DONOR_REPEATS):
            ks = permute.round_keys(DONOR_SEED, i * DONOR_REPEATS + r)
            rows.append(f"('{block}', {r}, " + ", ".join(str(v) for k in ks for v in k) + ")")
    names = [f"{c}{i}" for i in range(permute.ROUNDS) for c in ("m", "k", "u", "v")]
    left, right = "(x // b)", "(x % b)"
    steps, p = [], permute.P
    for i in range(permute.ROUNDS):  # one CTE a half round
        steps.append(f"(({{l}} + (({{r}} % {p} * m{i} + k{i}) % {p}) * (({{r}} % {p} * m{i} + k{i}) % {p}) % {p}) % a)")
        steps.append(f"(({{r}} + (({{l}} % {p} * u{i} + v{i}) % {p}) * (({{l}} % {p} * u{i} + v{i}) % {p}) % {p}) % b)")

    def rounds(src: str) -> str:
        sql = f"SELECT *, {left} AS l, {right} AS r FROM {src}"
        for i, step in enumerate(steps):
            to = "l" if i % 2 == 0 else "r"
            sql = f"SELECT * REPLACE ({step.format(l='l', r='r')} AS {to}) FROM ({sql})"
        return sql

    return with_views(f"""
SELECT block, rep, CAST(isodow(p.date) - 1 AS INTEGER) AS own_weekday, CAST(isodow(d.date) - 1 AS INTEGER) AS donor_weekday,
       count(*) AS n, CAST(sum(w.pos * 31 + w.x) AS BIGINT) AS places
FROM walk w JOIN ranked p ON p.pos = w.x JOIN ranked d ON d.pos = w.pos WHERE w.steps > 0 AND w.x < w.n GROUP BY ALL""",
                      "count_panel", extra={
        "ranked": "SELECT date, row_number() OVER (ORDER BY site, date) - 1 AS pos FROM count_panel",
        "size": "SELECT *, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM ranked)",
        f"keys(block, rep, {', '.join(names)})": f"VALUES {', '.join(rows)}",
        "walk(block, rep, pos, n, x, steps)": f"""
            SELECT block, rep, pos, n, pos, 0 FROM ranked, size, keys
            UNION ALL
            SELECT block, rep, pos, n, l * b + r, steps + 1
            FROM ({rounds("(SELECT w.*, s.a, s.b, k.* EXCLUDE (block, rep) FROM walk w, size s, keys k WHERE k.block = w.block AND k.rep = w.rep AND (w.steps = 0 OR w.x >= w.n))")})"""},
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("permutation_donors", _donor_sql())
def permutation_donors(spark, d):
    """X2/X3's donor map over all rows of the count panel, a table that is periodic in key order: for every
    block and repeat, how often a row of one weekday gets the values of another, and a digest of the places."""
    p = B.count_panel(spark, d).select("site", "date")
    base, n = number_rows(p, ["site", "date"], "pos")
    base = base.select((F.col("pos") - 1).alias("pos"), (F.weekday("date")).alias("weekday"))
    sent = explain.permuted_places(base, F.col("pos"), n, DONOR_BLOCKS, DONOR_REPEATS, DONOR_SEED)
    own = base.select(F.col("pos").alias("to"), F.col("weekday").alias("own_weekday"))
    j = sent.join(own, F.col("_pv_to") == F.col("to"))
    return (j.groupBy(F.col("_pv_block").alias("block"), F.col("_pv_rep").alias("rep"), "own_weekday", F.col("weekday").alias("donor_weekday"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos") * 31 + F.col("to")).alias("places")))


# ------------------------------------------------------------------- one small tree ---

TREE_FEATS = ["day_of_week", "day_of_month", "month"]

_LONG = "SELECT {by}, f, v, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM (SELECT *, unnest([0, 1, 2]) AS f, unnest([x0, x1, x2]) AS v FROM {src}) GROUP BY ALL"
_VAR = "(({q}) - ({s}) * ({s}) / CAST(({n}) AS DOUBLE)) / ({n})"


def _best(src: str, by: str) -> str:
    """The split of greatest gain of each node: cumulative counts, sums and squares below each midpoint."""
    whole = "PARTITION BY {by}, f".format(by=by)
    gain = (f"({_VAR.format(n='tn', s='ts', q='tq')}) - n / CAST(tn AS DOUBLE) * ({_VAR.format(n='n', s='s', q='q')})"
            f" - (tn - n) / CAST(tn AS DOUBLE) * ({_VAR.format(n='(tn - n)', s='(ts - s)', q='(tq - q)')})")
    return f"""
SELECT {by}, arg_max(f, gain) AS f, arg_max(t, gain) AS t, max(gain) AS gain FROM (
  SELECT {by}, f, t, {gain} AS gain FROM (
    SELECT {by}, f, (v + lead(v) OVER w) / 2.0 AS t, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(s) OVER w AS BIGINT) AS s, CAST(sum(q) OVER w AS BIGINT) AS q,
           CAST(sum(n) OVER ({whole}) AS BIGINT) AS tn, CAST(sum(s) OVER ({whole}) AS BIGINT) AS ts, CAST(sum(q) OVER ({whole}) AS BIGINT) AS tq
    FROM ({_LONG.format(by=by, src=src)}) WINDOW w AS ({whole} ORDER BY v ROWS UNBOUNDED PRECEDING)) WHERE t IS NOT NULL)
GROUP BY {by}"""


def _stats(src: str, node: str) -> str:
    return (f"SELECT {node} AS node, count(*) AS n, sum(y) / CAST(count(*) AS DOUBLE) AS prediction, "
            f"{_VAR.format(n='count(*)', s='CAST(sum(y) AS BIGINT)', q='CAST(sum(y * y) AS BIGINT)')} AS impurity FROM {src} GROUP BY ALL")


#: Nodes in the order that MLlib writes them: root 0, left 1 with leaves 2 and 3, right 4 with 5 and 6.
_TREE_CTES = {
    "rows0": "SELECT CAST(isodow(date) - 1 AS DOUBLE) AS x0, CAST(day(date) AS DOUBLE) AS x1, CAST(month(date) AS DOUBLE) AS x2, daily_count AS y, 0 AS node FROM count_panel",
    "best0": _best("rows0", "node"),
    "rows1": "SELECT r.* REPLACE (CASE WHEN [x0, x1, x2][f + 1] <= t THEN 1 ELSE 4 END AS node) FROM rows0 r, best0",
    "best1": _best("rows1", "node"),
    "rows2": "SELECT r.* REPLACE (CASE WHEN [x0, x1, x2][f + 1] <= t THEN r.node + 1 ELSE r.node + 2 END AS node) FROM rows1 r JOIN best1 USING (node)",
    "splits": "SELECT * FROM best0 UNION ALL SELECT * FROM best1",
    "stats": " UNION ALL ".join(_stats(f"rows{i}", "node") for i in range(3)),
    "nodes": """SELECT s.node, s.n, s.prediction, s.impurity, coalesce(b.gain, -1.0) AS gain, coalesce(b.f, -1) AS feature, b.t AS threshold,
                       CASE WHEN b.f IS NULL THEN -1 ELSE s.node + 1 END AS "left", CASE WHEN b.f IS NULL THEN -1 WHEN s.node = 0 THEN 4 ELSE s.node + 2 END AS "right"
                FROM stats s LEFT JOIN splits b USING (node)""",
    "importance": """SELECT k AS i, ['day_of_week', 'day_of_month', 'month'][k + 1] AS feature,
                            coalesce((SELECT sum(gain * n) FROM nodes WHERE nodes.feature = k), 0) / (SELECT sum(gain * n) FROM nodes WHERE nodes.feature >= 0) AS importance
                     FROM (SELECT unnest([0, 1, 2]) AS k)""",
}


def _tree_sql(body: str) -> str:
    return with_views(body, "count_panel", extra=_TREE_CTES)


def _tree(spark, d):
    """The model, its node table and the rows' columns."""
    p = features.calendar_parts(B.count_panel(spark, d), "date", holidays=(), recurring=cal.RECURRING_HOLIDAYS)
    p = materialize(p.select("daily_count", *TREE_FEATS))
    model = learn.forest("daily_count", numTrees=1, maxDepth=2, bootstrap=False).fit(learn.assemble(p, TREE_FEATS))
    return p, forest.node_table(spark, model)


@query("tree_nodes", _tree_sql("""
SELECT CAST(node AS INTEGER) AS node, n, round(prediction, 6) AS prediction, round(impurity, 6) AS impurity, round(gain, 6) AS gain,
       CAST(feature AS INTEGER) AS feature, CAST(threshold AS DOUBLE) AS threshold, CAST("left" AS INTEGER) AS "left", CAST("right" AS INTEGER) AS "right"
FROM nodes"""))
def tree_nodes(spark, d):
    """L2 with one unsampled tree: the node table of the fitted model."""
    return round_doubles(_tree(spark, d)[1].drop("tree", "weight"))


@query("tree_importance", _tree_sql("""
SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, i) AS INTEGER) AS rank FROM importance"""))
def tree_importance(spark, d):
    """X1 from the node table."""
    return round_doubles(forest.node_importance(_tree(spark, d)[1], TREE_FEATS))


@query("tree_group_importance", _tree_sql("""
SELECT CASE WHEN feature LIKE '%day%' THEN 'day' WHEN feature LIKE '%month%' THEN 'month' ELSE 'other' END AS "group",
       round(sum(importance), 6) AS importance, count(*) AS n_features FROM importance GROUP BY 1"""))
def tree_group_importance(spark, d):
    """X5 + P18: importances summed over blocks of columns found by name patterns."""
    imp = forest.node_importance(_tree(spark, d)[1], TREE_FEATS)
    blocks = features.blocks_by_pattern(TREE_FEATS, contains={"day": ["day"], "month": ["month"]})
    owner = {f: b for b, fs in reversed(blocks.items()) for f in fs}  # a column of several blocks counts in the first
    mapping = spark.createDataFrame(list(owner.items()), "feature string, group string")
    return round_doubles(explain.group_importance(imp, mapping))


_WALK = """
SELECT g.feature, g.value, round(sum(leaf.prediction * CASE WHEN r.feature = g.k THEN CAST((g.value <= r.threshold) = (inner_.node = 1) AS INTEGER) ELSE inner_.n / CAST(r.n AS DOUBLE) END
       * CASE WHEN inner_.feature = g.k THEN CAST((g.value <= inner_.threshold) = (leaf.node = inner_."left") AS INTEGER) ELSE leaf.n / CAST(inner_.n AS DOUBLE) END), 6) AS mean_prediction
FROM (SELECT DISTINCT ['day_of_week', 'day_of_month', 'month'][k + 1] AS feature, k, v AS value FROM (SELECT unnest([0, 1, 2]) AS k, unnest([x0, x1, x2]) AS v FROM rows0)) g,
     nodes r, nodes inner_, nodes leaf
WHERE r.node = 0 AND inner_.node IN (r."left", r."right") AND leaf.node IN (inner_."left", inner_."right") GROUP BY ALL"""


@query("tree_dependence", _tree_sql(_WALK))
def tree_dependence(spark, d):
    """X4 in the form of tree recursion: a weighted walk through the node table for every value of each feature."""
    p, nodes = _tree(spark, d)
    return round_doubles(explain.tree_dependence(nodes, TREE_FEATS, explain.dependence_grid(p, TREE_FEATS)))


@query("tree_dependence_rows", _tree_sql("""
SELECT g.feature, g.value, round(avg(leaf.prediction), 6) AS mean_prediction
FROM (SELECT DISTINCT ['day_of_week', 'day_of_month', 'month'][k + 1] AS feature, k, v AS value FROM (SELECT unnest([0, 1, 2]) AS k, unnest([x0, x1, x2]) AS v FROM rows0)) g
JOIN rows0 x ON true JOIN nodes r ON r.node = 0
JOIN nodes i ON i.node = CASE WHEN (CASE WHEN r.feature = g.k THEN g.value ELSE [x0, x1, x2][r.feature + 1] END) <= r.threshold THEN r."left" ELSE r."right" END
JOIN nodes leaf ON leaf.node = CASE WHEN (CASE WHEN i.feature = g.k THEN g.value ELSE [x0, x1, x2][i.feature + 1] END) <= i.threshold THEN i."left" ELSE i."right" END
GROUP BY ALL"""))
def tree_dependence_rows(spark, d):
    """X4 over all rows: every row predicted at every value of each feature."""
    p = features.calendar_parts(B.count_panel(spark, d), "date", holidays=(), recurring=cal.RECURRING_HOLIDAYS)
    p = materialize(p.select("daily_count", *TREE_FEATS))
    model = learn.forest("daily_count", numTrees=1, maxDepth=2, bootstrap=False).fit(learn.assemble(p, TREE_FEATS))
    return round_doubles(explain.partial_dependence(p, model, TREE_FEATS, TREE_FEATS))


@query("forest_dependence")
def forest_dependence(spark, d):
    """X4 in the form of tree recursion on the count forest: the three features of greatest importance, 100 points."""
    from .queries_model import COUNT_FEATS, _count_forest
    p, model = _count_forest(spark, d)
    nodes = cut_lineage(forest.node_table(spark, model))
    top = [r["feature"] for r in forest.node_importance(nodes, COUNT_FEATS).orderBy("rank").limit(3).collect()]
    return round_doubles(explain.tree_dependence(nodes, COUNT_FEATS, explain.dependence_grid(p, top)))
