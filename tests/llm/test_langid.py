from helpers import docs, edge_rows, empty

from gridrisk.llm import langid
from gridrisk.llm.common import ship


def corpus(spark):
    import random
    rng = random.Random(1)
    speech = {"aa": ["tor", "nim", "kala", "vesi", "puu", "maja"], "bb": ["the", "house", "water", "tree", "stone", "hill"]}
    rows = []
    for i in range(200):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join(rng.choice(speech[lang]) for _ in range(40)), lang))
    return rows


def test_learns_and_predicts_held_out(spark):
    ship(spark)
    rows = corpus(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id % 5 != 0"))
    assert model.languages == ("aa", "bb")  # most training rows first
    got = langid.identify(df.filter("doc_id % 5 = 0").drop("lang"), model).collect()
    want = {i: x for i, _, x in rows}
    assert all(r["language"]["lang_pred"] == want[r["doc_id"]] for r in got)
    assert all(0 <= r["language"]["score"] <= 1 and not r["language"]["rejected"] for r in got)


def test_labels_and_other_columns_are_no_input(spark):
    ship(spark)
    rows = corpus(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    plain = {r["doc_id"]: r["language"] for r in langid.identify(df.select("doc_id", "text"), model).collect()}
    other = {r["doc_id"]: r["language"] for r in langid.identify(df.selectExpr("doc_id", "text", "'bb' AS lang"), model).collect()}
    assert plain == other


def test_edges(spark):
    ship(spark)
    model = langid.train(spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string"))
    got = langid.identify(docs(spark, edge_rows(), extra=True), model)
    assert "own" not in {str(x) for x in got.select("language").first()}
    rows = got.collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["language"]["lang_pred"] == "und") == (not letters)
        if not letters:
            assert r["language"]["score"] == 0 and r["language"]["rejected"]
    assert langid.identify(empty(spark), model).count() == 0


def test_nothing_to_learn(spark):
    ship(spark)
    model = langid.train(docs(spark, [(1, None), (None, "text without an id")]))
    assert model.languages == ()
    assert langid.identify(docs(spark, [(1, "words")]), model).first()["language"]["lang_pred"] == "und"
    one = langid.train(docs(spark, [(1, "some words to learn from")]))
    assert langid.identify(docs(spark, [(1, "words")]), one).first()["language"]["lang_pred"] == "en"


def test_null_labels_are_left_out(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, "d e f", "xx")], "doc_id long, text string, lang string")
    assert langid.train(df).languages == ("xx",)


def test_sample_is_bounded():
    assert langid.SAMPLE_DOCS * langid.PIECE_CHARS < 1 << 20
    c = langid.Classifier(langid.LanguageModel(("a", "b"), (b"hello world " * 10, b"adieu monde " * 10)))
    assert c.judge("hello world hello")[0] == "a" and c.judge("adieu monde adieu")[0] == "b"
    assert c.judge("123 !?") == ("und", 0.0)
