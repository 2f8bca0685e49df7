import random

from helpers import docs, edge_rows, empty
from pyspark.sql import functions as F

from gridrisk.llm import merkle
from gridrisk.llm.common import ship, two, with_next


def text(seed, n=400):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh") + rng.choice(["", "", "", " ", "\n", ". "]) for _ in range(n * 4))


def test_roots_test_equality():
    a = text(1)
    assert merkle.tree(a) == merkle.tree(a) and merkle.likeness(merkle.tree(a), merkle.tree(a)) == 1
    assert merkle.tree(a).split("/")[0] != merkle.tree(a + " ").split("/")[0]
    assert merkle.tree(None) == merkle.tree("")
    assert merkle.likeness(merkle.tree(""), merkle.tree(None)) == 1 and merkle.likeness(merkle.tree(""), merkle.tree("x")) == 0
    assert merkle.likeness(None, merkle.tree("x")) == 0


def test_likeness_follows_the_edit():
    for seed in range(20):
        a, b = text(seed), text(seed + 100)
        half = a[:len(a) // 2] + b[:len(a) // 2]
        tenth = a[:len(a) // 2] + "an edit" + a[len(a) // 2:]
        near = merkle.likeness(merkle.tree(a), merkle.tree(half))
        assert 0.3 < near < 0.7
        assert merkle.likeness(merkle.tree(a), merkle.tree(tenth)) > 0.85
        assert merkle.likeness(merkle.tree(a), merkle.tree(b)) < 0.1
        assert near == merkle.likeness(merkle.tree(half), merkle.tree(a))


def test_branches_locate_edits():
    a = text(3)
    b = a[:700] + "EDIT" + a[704:]
    found = merkle.edits(merkle.tree(a), merkle.tree(b))
    assert found and found[0][0] <= 700 and found[-1][1] >= 704 and sum(y - x for x, y in found) < 500
    assert merkle.edits(merkle.tree(a), merkle.tree(a)) == []
    assert merkle.edits(merkle.tree("abc def"), merkle.tree("")) == [(0, 7)]


def test_pieces_cover_the_text():
    for t in (text(5), "x" * 5000, "\n\n\n", "a\n\nb", "é漢" * 900, " " * 999):
        fp = merkle.tree(t)
        assert sum(int(x[9:], 16) for s in merkle._sections(fp) for p in merkle._paragraphs(s) for x in merkle._pieces(p)) == len(t.encode())


def test_frame_edges(spark):
    ship(spark)
    rows = merkle.fingerprint(docs(spark, edge_rows(), extra=True)).collect()
    assert all(r["fingerprint"] == merkle.tree(r["text"]) for r in rows) and len(rows) == len(edge_rows())
    assert merkle.fingerprint(empty(spark)).count() == 0


def test_next_row(spark):
    ship(spark)
    for n in (1, 2, 57):
        rows = [(i * 3, f"text {i}") for i in range(n)]
        got = {r["id"]: r["next_text"] for r in with_next(two(docs(spark, rows).repartition(5), "doc_id", "text"), ["text"], per_bucket=5).collect()}
        assert got == {i * 3: f"text {(i + 1) % n}" for i in range(n)}
    rows = [(None, "a"), (1, "c"), (1, "b"), (2, "d")]
    got = with_next(two(docs(spark, rows), "doc_id", "text"), ["text"]).select("text", "next_text")
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    assert with_next(two(empty(spark), "doc_id", "text"), ["text"]).count() == 0


def test_like_column(spark):
    ship(spark)
    df = merkle.fingerprint(merkle.fingerprint(spark.createDataFrame([(text(1), text(1)), (text(1), text(2))], "a string, b string"), "a", "fa"), "b", "fb")
    got = [r[0] for r in df.select(merkle.like("fa", "fb")).collect()]
    assert got[0] == 1 and got[1] < 0.1
    assert df.filter(F.col("fa") == F.col("fb")).count() == 1


def test_compared_equals_the_parts(spark):
    ship(spark)
    rows = docs(spark, edge_rows(), extra=True).withColumn("other", F.reverse("text")).withColumn("third", F.col("text")).withColumn("copy", F.col("text"))
    got = merkle.compared(rows, "text", ["other", "third"], ["doc_id", "copy"]).collect()
    for r in got:
        fp, rev = merkle.tree(r["copy"]), merkle.tree((r["copy"] or "")[::-1])
        assert (r["fingerprint"], r["other_fingerprint"], r["near_other"], r["near_third"]) == (fp, rev, merkle.likeness(fp, rev), 1.0)
    assert len(got) == len(edge_rows())
