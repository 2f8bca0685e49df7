import random
from hashlib import sha256

import pytest
from helpers import docs, edge_rows, empty
from pyspark.sql import functions as F

from gridrisk.llm import manifest
from gridrisk.llm.common import ship

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root of the row with n_chars + 1) for every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in groups[g]]))
    whole = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = proof(trees[k], i) + proof(whole, k)
            node = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            for right, other in steps:
                node = H(node) if other is None else H(other, node) if right else H(node, other)
            out.append((r[0], leaf(r), trees[k][-1][0], whole[-1][0], [o for _, o in steps if o], node, node == whole[-1][0]))
    return sorted(out, key=repr)


def table(seed, n, langs):
    rng = random.Random(seed)
    pick = lambda: rng.choice(langs)
    return [(rng.choice([None, rng.randrange(10 * n)]) if i % 9 == 0 else 1000 + i, rng.choice(["s", None, "é"]), pick(),
             rng.choice([None, i]), rng.choice([None, "", "text\n" * (i % 4), "漢"])) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n,langs,bits", [(1, ["en"], 2), (2, ["en"], 2), (5, [None, "en"], 1), (40, ["en"] * 8 + ["é", "z", None, ""], 2),
                                           (300, ["en"] * 9 + [f"l{i}" for i in range(9)], 3), (70, ["en"], 11)])
def test_against_brute_force(spark, n, langs, bits):
    ship(spark)
    rows = table(n, n, langs)
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    more = manifest.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    made = manifest.build(df, COLUMNS, candidate=more, bits=bits)
    got = sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["verified"]) for r in made.proofs.collect()), key=repr)
    want = brute(rows)
    assert got == want and made.root == want[0][3]
    assert {r["subroot"] for r in made.subroots.collect()} == {w[2] for w in want}
    untouched = manifest.build(df, COLUMNS, bits=bits).proofs
    assert untouched.filter("not verified or folded_root <> root").count() == 0


def test_edges(spark):
    ship(spark)
    made = manifest.build(empty(spark), COLUMNS)
    assert made.root is None and made.proofs.count() == 0 and made.subroots.count() == 0
    df = docs(spark, edge_rows(), extra=True).selectExpr("*", "'own' AS grp", "'own' AS pos", "'own' AS node", "'own' AS proof", "'own' AS part")
    out = manifest.build(df, COLUMNS).proofs
    assert out.count() == len(edge_rows()) and out.filter("not verified").count() == 0
    assert out.select("root").distinct().count() == 1


def test_a_change_anywhere_shows(spark):
    ship(spark)
    rows = table(3, 30, ["en", "de"])
    root = manifest.build(spark.createDataFrame(rows, SCHEMA), COLUMNS).root
    for k in range(5):
        row = list(rows[7])
        row[k] = {0: 5, 1: "t", 2: "fr", 3: 999, 4: "other"}[k]
        changed = rows[:7] + [tuple(row)] + rows[8:]
        assert manifest.build(spark.createDataFrame(changed, SCHEMA), COLUMNS).root != root
    assert manifest.build(spark.createDataFrame(rows[::-1], SCHEMA), COLUMNS, bits=2).root == root
