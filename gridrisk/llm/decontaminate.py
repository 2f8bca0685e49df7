"""Benchmark decontamination by n-gram windows.

Texts become words: ASCII letters in lower case, digits and every non-ASCII character; all else
separates.  A benchmark item gives its windows of ``window`` consecutive words (an item with
fewer words, but not none, is one window of its own length).  The windows' hashes go to the
executors as a broadcast set; each document's own windows are hashed in a rolling scan, hits are
verified word by word, and the words under any verified window are marked.  Marked spans or whole
documents can then be removed.

The broadcast holds at most about ``block_bytes`` of benchmark text: a larger benchmark is dealt
into blocks by a hash of its items and the documents are scanned once for each block, carrying
what earlier blocks found.  No step shuffles the documents.

Defined results: null and wordless texts have no words, no hits and stay as they are; null or
wordless items have no window; an item that occurs twice counts twice unless the id is the same;
a null item id is left out of the list of items but its text still marks words.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, list_column, steps, two

WINDOW = 10
BLOCK_BYTES = 32 << 20

_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


class WindowIndex:
    """The windows of one block of items: a vocabulary, and for each window length the sorted
    hashes, the windows themselves and the items that have them."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [number(w, len(self.vocabulary)) for w in words(text)]
            if not ids:
                continue
            n = min(window, len(ids))
            at = found.setdefault(n, {})
            for i in range(len(ids) - n + 1):
                at.setdefault(tuple(ids[i:i + n]), set()).add(item)
        self.tables = {n: self._table(n, at) for n, at in sorted(found.items())}

    @staticmethod
    def _table(n: int, at: dict[tuple, set]):
        grams = np.array(list(at), dtype=np.int32).reshape(len(at), n)
        owners = list(at.values())
        factor = 0x9E3779B97F4A7C15
        while True:  # another odd factor until all windows of the block have hashes of their own
            hashes = rolling(grams.T, factor)
            order = np.argsort(hashes)
            if len(order) < 2 or (np.diff(hashes[order]) != 0).all():
                break
            factor = (factor * 0xBF58476D1CE4E5B9 + 2) & (1 << 64) - 1 | 1
        return factor, hashes[order], grams[order], [owners[i] for i in order]

    def scan(self, doc: list[bytes]) -> tuple[np.ndarray, set, int]:
        """Marks for each word of ``doc``, the items that have a window in it, and the longest window found."""
        ids = np.fromiter(map(self.vocabulary.get, doc, repeat(-1)), np.int32, len(doc))
        delta, items, longest = np.zeros(len(doc) + 1, dtype=np.int32), set(), 0
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, (factor, hashes, grams, owners) in self.tables.items():
            if len(doc) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            h = rolling([ids[starts + k] for k in range(n)], factor)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            same = np.fromiter((bool((ids[s:s + n] == grams[j]).all()) for s, j in zip(starts[hit], k[hit], strict=True)),
                               bool, len(hit))
            for s, j in zip(starts[hit][same], k[hit][same], strict=True):
                delta[s] += 1
                delta[s + n] -= 1
                items |= owners[j]
                longest = n
        return np.cumsum(delta)[:-1] > 0, items, longest


def rolling(columns, factor: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = h * np.uint64(factor) + c.astype(np.uint64) + np.uint64(1)
    return h


def _runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) of the runs of True, flattened."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.astype(np.int32)


def _unruns(flat, n: int) -> np.ndarray:
    mask = np.zeros(n, dtype=bool)
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        mask[a:b] = True
    return mask


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> list:
    """The windows of the benchmark as broadcasts of bounded size, at least one."""
    spark = benchmark.sparkSession
    bench = two(benchmark, item_col, item_text_col).filter("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    out = []
    for b in range(n):
        block = bench if n == 1 else bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        rows = [(None if r["id"] is None else str(r["id"]), r["text"]) for r in block.collect()]
        out.append(spark.sparkContext.broadcast(WindowIndex(rows, window)))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_words``, ``n_hit`` (marked words), ``spans`` (flat word positions
    start, end, start, end, ... of the marked runs) and ``items`` (distinct ids, as strings, sorted as
    strings)."""
    out = two(docs, id_col, text_col)
    found = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
             T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    head = [out.schema["id"], out.schema["text"]]
    indexes = _indexes(benchmark, item_col, item_text_col, window, block_bytes)
    for b, index in enumerate(indexes):
        if b:
            out = cut_lineage(out)
        last = b == len(indexes) - 1  # only a scan that another follows hands the text on
        out = out.mapInArrow(_scanner(index, carry=bool(b), last=last), T.StructType(head[:1 if last else 2] + found))
    return out


def _scanner(index, carry: bool, last: bool):
    def run(batches):
        look = index.value
        for whole in batches:
            for batch in steps(whole):
                n_words, n_hit, spans, items = [], [], [], []
                texts = batch.column(1)
                before = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True) if carry else repeat(((), ()))
                for text, (old_spans, old_items) in zip(texts, before, strict=False):
                    doc = words(text.as_py())
                    mask, had, _ = look.scan(doc)
                    if old_spans:
                        mask |= _unruns(old_spans, len(doc))
                    n_words.append(len(doc))
                    n_hit.append(int(mask.sum()))
                    spans.append(_runs(mask).tobytes())
                    items.append(sorted({x for x in had if x is not None}.union(old_items)))
                head = [batch.column(0)] if last else [batch.column(0), texts]
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), list_column(spans),
                     pa.array(items, pa.list_(pa.string()))],
                    names=["id", *["text"] * (not last), "n_words", "n_hit", "spans", "items"])
    return run


def _marker(index, last: bool, drop_from: int):
    """Spans and longest window by one more block; after the last one the text without those spans instead (null if the
    document goes), so that one Python worker marks and cuts."""
    found = T.StructField("text", T.StringType()) if last else T.StructField("spans", T.ArrayType(T.IntegerType()))
    kind = T.StructType([found, T.StructField("longest", T.IntegerType())])

    def mark(texts: pa.Array, before: pa.Array) -> pa.Array:
        look, spans, longest = index.value, [], []
        for text, old in zip(texts, before, strict=True):
            doc = words(text.as_py())
            mask, _, n = look.scan(doc)
            old_spans, old_n = old["spans"].as_py(), old["longest"].as_py()
            if old_spans:
                mask |= _unruns(old_spans, len(doc))
            spans.append(_runs(mask).tobytes())
            longest.append(max(n, old_n))
        if last:
            left = [None if n >= drop_from else cut_spans(t.as_py(), np.frombuffer(s, dtype=np.int32))
                    for t, s, n in zip(texts, spans, longest, strict=True)]
            return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(longest, pa.int32())], names=["text", "longest"])
        return pa.StructArray.from_arrays([list_column(spans), pa.array(longest, pa.int32())], names=["spans", "longest"])

    return F.arrow_udf(mark, kind).asNondeterministic()


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", window: int = WINDOW, drop_from: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, decontaminated: a document with a hit of at least ``drop_from`` words goes,
    and from the others the spans under shorter items are cut.  Nothing is shuffled."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"),
                       F.expr("named_struct('spans', cast(array() as array<int>), 'longest', 0)").alias("_hits"))
    indexes = _indexes(benchmark, item_col, item_text_col, window, block_bytes)
    for b, index in enumerate(indexes):
        if b:
            rows = cut_lineage(rows)
        rows = rows.withColumn("_hits", _marker(index, b == len(indexes) - 1, drop_from)("_text", "_hits"))
    rows = rows.filter(F.col("_hits.longest") < drop_from)
    return rows.select(*[F.col("_hits.text").alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in names])


def cut_spans(text: str | None, flat) -> str | None:
    """The text without the characters from a span's first word to its last."""
    if not text or not len(flat):
        return text
    body = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(body.translate(_WORD), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep, at = [], 0
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        keep.append(body[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*keep, body[at:]]).decode("utf-8", "surrogatepass")
