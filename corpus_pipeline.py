"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.  Where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridrisk.llm import bpe, decontaminate, langid, linededup, ngramjoin
from gridrisk.llm.common import bounded_batches, ensure_checkpoint_dir, read_table, ship


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the labelled documents; those that it rejects go (no letters, or no clear lead)."""
    ship(spark)
    bounded_batches(spark)
    verdict = fresh(docs, "verdict")
    judged = langid.identify(docs, langid.train(docs), out=verdict)
    return judged.filter(~F.col(f"{verdict}.rejected")).drop(verdict)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later repeats of runs of lines go, and documents that consist of such repeats alone."""
    ship(spark)
    bounded_batches(spark)
    n = fresh(docs, "n_deleted")
    out = linededup.dedup(docs, out=n)
    return counted(out.filter((F.col(n) == 0) | (F.col("text") != "")).drop(n))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the least id stays; of rows that
    share an id the one whose text is least.  Rows without an id stay."""
    ship(spark)
    bounded_batches(spark)
    near = ngramjoin.near_duplicates(docs)
    stay = near.filter("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    row = fresh(docs, "row")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = docs.join(stay, "doc_id", "left_semi").withColumn(row, first).filter(F.col(row) == 1).drop(row)
    return kept.unionByName(docs.filter("doc_id is null"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a full window of an item go; shorter items' spans are cut."""
    ship(spark)
    bounded_batches(spark)
    return counted(decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the columns of the documents with the text decoded from its ids, ``ids`` and ``n_tokens``."""
    ship(spark)
    bounded_batches(spark)
    vocabulary = bpe.load_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = fresh(docs, "bpe")
    coded = bpe.with_ids(docs, vocabulary, public_tokenizers.PATTERN, out=out)
    columns = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    return coded.select(*[F.col(f"{out}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns],
                        F.col(f"{out}.ids").alias("ids"), F.size(f"{out}.ids").cast("long").alias("n_tokens"))


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage),
          ("benchmark decontamination", benchmark_stage), ("byte-level BPE", token_stage)]

#: The first stage compresses with dictionaries, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
