"""Line dedup: winnowing over line hashes.

A document is its lines that aren't blank, without white space around them.  Pairs of neighbouring
lines are hashed, and of every ``WINDOW`` neighbouring pairs the least (the last of equals) is a
fingerprint.  So any run of ``WINDOW + 1`` lines contains a fingerprint, at the same place wherever
the run occurs.  Fingerprints that occur once are dropped; the others are extended to both sides to
every run of that length that contains them, occurrences of a run are joined with the first one (by
document id, then position), and the lines of all later occurrences are deleted.  Longer repeats
are unions of such runs, so a run is deleted wholly wherever it ends.  A line of at least
``LONG_LINE`` words is a run of its own, and with ``pairs`` so are two neighbouring lines that have as
many words together and fewer each.

Firsts are grouped minima with partial aggregation, so a line that a third of the documents share costs
a row for each task; occurrences are joined back row by row, never gathered.

Defined results: null and empty texts stay; blank lines stay, but a text left with blank lines only
becomes empty; rows that share an id count as one document; rows with a null id are neither searched nor changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, steps, two

WINDOW = 2
LONG_LINE = 40
_BLANK = " \t\r\x0b\x0c"

_RUN = T.StructType([T.StructField("mark", T.LongType()), T.StructField("key", T.LongType()),
                     T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])


def lines(text: str) -> list[str]:
    return [s for s in (x.strip(_BLANK) for x in text.split("\n")) if s]


def _chain(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One hash for each n neighbouring hashes."""
    out = np.full(len(hashes) - n + 1, seed, dtype=np.uint64)
    for i in range(n):
        out = (out ^ hashes[i:len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least of every ``window`` neighbours, the last of equals."""
    if len(grams) < window:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


def runs(text: str, window: int, long_line: int, pairs: bool = True) -> list[np.ndarray]:
    """Fingerprint, run hash, first line and number of lines of each run that contains a fingerprint."""
    body = lines(text)
    hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in body], dtype=np.uint64)
    n = window + 1
    parts = []
    if len(body) >= n:
        grams, whole = _chain(hashes, 2, 1), _chain(hashes, n, 2)
        picked = winnow(grams, window)
        for back in range(window):
            at = picked - back
            ok = (at >= 0) & (at < len(whole))
            parts.append((grams[picked[ok]], whole[at[ok]], at[ok], np.full(ok.sum(), n)))
    count = np.array([len(x.encode("utf-8", "surrogatepass").split()) for x in body], dtype=np.int64)
    long = np.flatnonzero(count >= long_line)
    if len(long):
        own = _chain(hashes[long], 1, 3)
        parts.append((own, own, long, np.ones(len(long), dtype=np.int64)))
    both = np.flatnonzero((count[:-1] < long_line) & (count[1:] < long_line) & (count[:-1] + count[1:] >= long_line)) if pairs else long[:0]
    if len(both):
        own = _chain(hashes, 2, 4)[both]
        parts.append((own, own, both, np.full(len(both), 2)))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
             long_line: int = LONG_LINE, pairs: bool = True) -> DataFrame:
    """Runs to delete: ``id``, ``at`` (first line, of those not blank), ``n`` (lines), ``first_id`` and ``first_at``."""
    rows = two(docs, id_col, text_col).filter("id is not null and text is not null")

    def fingerprints(batches):
        for whole in batches:
            for batch in steps(whole):
                rows_of, parts = [], []
                for i, text in enumerate(batch.column(1)):
                    if found := runs(text.as_py(), window, long_line, pairs):
                        rows_of.append(np.full(len(found[0]), i))
                        parts.append(found)
                if parts:
                    mark, key, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.concatenate(rows_of))), pa.array(mark.view(np.int64)),
                         pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                        names=["id", "mark", "key", "at", "n"])

    found = cut_lineage(rows.mapInArrow(fingerprints, T.StructType([rows.schema["id"], *_RUN.fields])).distinct())
    shared = found.groupBy("mark").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("mark")
    extended = found.join(shared, "mark").select("key", "id", "at", "n").distinct()
    firsts = (extended.groupBy("key").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("c"))
                      .filter("c > 1").select("key", "first"))
    later = extended.join(firsts, "key").filter("id != first.id or at != first.at")
    return later.select("id", "at", "n", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    out = []
    for text, at, n in zip(texts.to_pylist(), starts.to_pylist(), lengths.to_pylist(), strict=True):
        if text and at:
            drop = {i for a, k in zip(at, n, strict=True) for i in range(a, a + k)}
            kept, i, left = [], -1, False
            for line in text.split("\n"):
                if line.strip(_BLANK):
                    i += 1
                    if i in drop:
                        continue
                    left = True
                kept.append(line)
            text = "\n".join(kept) if left else ""
        out.append(text)
    return pa.array(out, pa.string())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "n_deleted", window: int = WINDOW,
          long_line: int = LONG_LINE, pairs: bool = True) -> DataFrame:
    """All columns of ``docs``, the text without later repeated runs, and ``out``: lines deleted
    (a column of that name is replaced)."""
    later = repeated(docs, id_col, text_col, window, long_line, pairs)
    # distinct first lines of each length, so that a document's list is no longer than its lines
    cuts = later.groupBy(F.col("id").alias("_cut_id")).agg(
        F.collect_set(F.struct("at", "n")).alias("_cuts"))
    columns = [c for c in docs.columns if c != out]
    key = F.col(f"_doc.`{id_col}`")
    text = F.col(f"_doc.`{text_col}`").cast("string")
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")).join(cuts, key == F.col("_cut_id"), "left")
    # not deterministic: a filter on the text, pushed down, would cut all texts twice, by a second Python worker for each task
    new = _without.asNondeterministic()(text, F.col("_cuts")["at"], F.col("_cuts")["n"])
    deleted = F.size(F.array_distinct(F.flatten(F.transform("_cuts", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in columns],
                         F.when(F.col("_cuts").isNull(), 0).otherwise(deleted).cast("long").alias(out))
