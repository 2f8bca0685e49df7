"""Small tables and brute-force versions for the corpus operators."""

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """Documents from (id, text) pairs; ``extra`` adds columns whose names the operators use themselves."""
    data = [(i, t, "en", "s", len(t) if t else 0) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    if extra:
        for name in ("id", "n", "k", "s", "ids", "spans", "items", "language", "fingerprint", "n_deleted", "bpe", "at", "bucket"):
            df = df.selectExpr("*", f"'own' AS {name}")
    return df


def edge_rows():
    """Null, empty and blank texts, ties, repeated rows, a null id, a very long text and one long word."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    long = " ".join(word() for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two three"),
            (6, long), (7, "x" * 100_000), (8, "…  é́ 漢字 \x00 \x1c 👍"), (9, long + " tail"), (4, None)]


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


LONG = T.LongType()
