"""Language ID by compression.

Each language gets a raw-content zstandard dictionary: pieces of labelled texts, normalised.
A text is normalised the same way, cut into blocks, and every block is compressed once per
language with that language's dictionary; the language whose dictionary gives the fewest bytes
over the whole text wins.  Blocks keep the dictionary's share of the work the same in a long text
as in a short one, so the margin between languages does not fade with length.

Learning reads a bounded sample: at most ``SAMPLE_DOCS`` pieces of ``PIECE_CHARS`` characters a
language, picked by a hash of the id among all labelled training rows, ``DICT_BYTES`` at most of
normalised text.  The counts that set the picking rate cover every training row.

Defined results: a null text or one without any letter is ``und`` with score 0 and is rejected.
With no labelled rows there is no language to learn and every text is ``und``.  With one language
the runner-up is compression without a dictionary.  Equal sizes go to the language with more
training rows (then the smaller name).  A null id is never learned from.  Repeated rows are
judged each on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DICT_BYTES = 64 << 10
SAMPLE_DOCS = 160
PIECE_CHARS = 600
BLOCK_BYTES = 1024
#: Texts under this many normalised bytes are compressed three times over in one block, as zstandard
#: stores very short blocks raw and then every language would cost the same.
SHORT_BYTES = 256
#: A lead of the winner under this share of the runner-up's bytes is too narrow to accept.
REJECT_MARGIN = 0.01

UND = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in tie order (most training rows first) with their dictionary bytes."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def normalise(text: str) -> bytes:
    """Lower-cased letters only, everything between them one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, piece_chars: int = PIECE_CHARS,
          dict_bytes: int = DICT_BYTES) -> LanguageModel:
    """Dictionaries from the rows of ``docs`` whose language and text are not null."""
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").cast("string").alias("lang"))
                .filter("id is not null and text is not null and lang is not null"))
    rows = rows.withColumn("pick", F.xxhash64(F.col("id").cast("string")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel((), ())
    # four times the rows wanted pass the rate where they lie, then a window of that bounded size takes the exact number
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4.0 * sample_docs / n))])
    share = F.pmod(F.col("pick"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.filter(share < F.element_at(rate, F.col("lang")))
    start = F.pmod(F.shiftright("pick", 30), F.greatest(F.length("text") - piece_chars, F.lit(1))) + 1
    near = near.withColumn("piece", F.substr("text", start.cast("int"), F.lit(piece_chars)))
    by = Window.partitionBy("lang").orderBy("pick", "id", "piece")
    sample = (near.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= sample_docs)
                  .select("lang", "k", "piece").collect())
    seen: dict[str, list[tuple[int, str]]] = {}
    for r in sample:
        seen.setdefault(r["lang"], []).append((r["k"], r["piece"]))
    order = sorted(seen, key=lambda x: (-counts[x], x))
    dictionaries = []
    for lang in order:
        body = b" ".join(normalise(piece) for _, piece in sorted(seen[lang]))
        dictionaries.append(body[:dict_bytes])
    return LanguageModel(tuple(order), tuple(dictionaries))


def _compressor(content: bytes | None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        6, source_size=4096, dict_size=DICT_BYTES, min_match=4, strategy=zstandard.STRATEGY_LAZY,
        window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0)
    if not content or len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=d)


class Classifier:
    """Judges texts with the compressors of one model; one per Python worker."""

    def __init__(self, model: LanguageModel):
        self.languages = model.languages
        self.compress = [_compressor(d).compress for d in model.dictionaries]
        if len(self.compress) == 1:
            self.compress.append(_compressor(None).compress)

    def sizes(self, text: str) -> list[int]:
        body = normalise(text)
        if len(body) < SHORT_BYTES:
            body = b" ".join((body, body, body))
        total = [0] * len(self.compress)
        for at in range(0, len(body), BLOCK_BYTES):
            block = body[at:at + BLOCK_BYTES]
            for i, compress in enumerate(self.compress):
                total[i] += len(compress(block))
        return total

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and score; the score is the lead of the winner over the runner-up, as a share."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UND, 0.0
        total = self.sizes(text)
        best = min(range(len(self.languages)), key=total.__getitem__)
        rival = min(n for i, n in enumerate(total) if i != best)
        return self.languages[best], min(1.0, max(0.0, 1.0 - total[best] / rival))



def _classifier(model: LanguageModel) -> Classifier:
    return common.held("classifier", model, lambda: Classifier(model))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language",
             reject_margin: float = REJECT_MARGIN) -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` of ``lang_pred``, ``score`` and ``rejected``.

    A column that already has the name ``out`` is replaced.  The model (languages x 64 KB, fixed
    by ``train``) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("rejected", T.BooleanType())])

    def judge(texts: pa.Array) -> pa.Array:
        classifier = _classifier(sent.value)
        got = [classifier.judge(t.as_py()) for t in texts]
        score = pa.array([s for _, s in got], pa.float64())
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in got], pa.string()), score,
             pa.array([x == UND or s < reject_margin for x, s in got], pa.bool_())],
            names=["lang_pred", "score", "rejected"])

    # not deterministic: keeps the planner from judging every text again in a pushed-down filter
    udf = F.arrow_udf(judge, kind).asNondeterministic()
    return docs.withColumn(out, udf(F.col(f"`{text_col}`").cast("string")))
