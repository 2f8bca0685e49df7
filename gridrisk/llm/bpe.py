"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by a pattern; each pre-token's bytes form a linked list whose
neighbouring pairs wait in buckets, one per merge rank.  A bitmap of two levels marks the
buckets in use: a bit a rank in words of 256, and a bit a word, so the next rank is two find-first-set
steps away, and a very long pre-token costs a bounded step per merge.  A bucket gives its leftmost
position first; an entry whose pair has changed meanwhile is stale and skipped.

Words repeat, so each Python worker remembers the ids of the pieces it has met (bounded by
``MEMO``); ``pieces`` says where a text can be cut so that its pieces can be encoded apart.

Defined results: a null text is the empty text, without ids; decoding a null list gives empty
bytes, and an id outside the vocabulary raises.  Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, list_column, steps, two
from .pieces import part_tail, pieces

#: Pieces that a worker remembers: as many as this, and those of the generation before that were met again.
MEMO = 300_000
#: The same where a codec runs at the end of a pipeline, whose executors' heaps are full by then.
LATE_MEMO = 150_000


class Codec(dict):
    """Encoder and decoder for one vocabulary; as a dict it maps met pieces to their ids as
    little-endian 32-bit numbers (a piece with a leading space has that space in its key)."""

    def __init__(self, vocabulary: bytes, pattern: str, memo: int | None = None):
        super().__init__()
        self.memo = memo
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        size = max(self.ranks.values(), default=0) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}
        # the queue, empty between pre-tokens: one bit a rank in words of 256, one bit a word in `top`
        self.words = [0] * ((size >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}

    def pre_token(self, body: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank merges first, the leftmost of equals."""
        rank_of = self.ranks.get
        whole = rank_of(body)
        if whole is not None:
            return [whole]
        n = len(body)
        words, buckets, top = self.words, self.buckets, 0
        part: list[bytes] = [body[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [None] * n  # the rank at which the pair that begins at a position waits
        for i in range(n - 1):
            rank = rank_of(body[i:i + 2])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so it is a heap already
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            # find-first-set twice: the first word in use, its first rank in use
            j = (top & -top).bit_length() - 1
            word = words[j]
            bit = word & -word
            rank = (j << 8) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word ^= bit
                words[j] = word
                if not word:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale: the pair has changed since
            k = after[i]
            part[i] += part[k]
            waiting[k] = None
            k = after[i] = after[k]
            if k < n:
                before[k] = i
                pair = rank_of(part[i] + part[k])
            else:
                pair = None
            waiting[i] = pair
            if pair is not None:
                if pair in buckets:
                    heappush(buckets[pair], i)
                else:
                    buckets[pair] = [i]
                    words[pair >> 8] |= 1 << (pair & 255)
                    top |= 1 << (pair >> 8)
            left = before[i]
            if left >= 0:
                other = waiting[left] = rank_of(part[left] + part[i])
                if other is not None:
                    if other in buckets:
                        heappush(buckets[other], left)
                    else:
                        buckets[other] = [left]
                        words[other >> 8] |= 1 << (other & 255)
                        top |= 1 << (other >> 8)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[part[i]])
            i = after[i]
        return ids

    def __missing__(self, piece: str) -> bytes:
        core, tail = part_tail(piece)
        if tail:
            return self[core] + self[tail]
        got = self.older.get(piece)
        if got is None:
            pre_tokens = self.split(piece)
            if len(pre_tokens) != 1:
                return b"".join([self[p] for p in pre_tokens])
            ids = self.pre_token(piece.encode("utf-8", "surrogatepass"))
            got = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= (self.memo or MEMO):
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return b"".join(map(self.__getitem__, pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(vocabulary: bytes, pattern: str, memo: int | None = None) -> Codec:
    return held("codec", (vocabulary, pattern, memo), lambda: Codec(vocabulary, pattern, memo))


def load_vocabulary(spark: SparkSession, path: str):
    """The rank file's bytes as a broadcast; the file has a fixed size and lies on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(c: Codec, batch: pa.RecordBatch) -> list[bytes]:
    return [c.encode(t.as_py()) if t.is_valid else b"" for t in batch.column(1)]


def encode(docs: DataFrame, vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of int) for every row."""
    rows = two(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(vocabulary.value, pattern)
        for whole in batches:
            for batch in steps(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), list_column(_encoded(c, batch))], names=["id", "ids"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocabulary, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``bytes`` for every row; the bytes are UTF-8 if the ids are a whole text's."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(vocabulary.value, pattern)
        for batch in batches:
            got = [c.decode(x.as_py()) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "bytes"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("bytes", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` and ``bytes`` decoded from those ids, in one pass over the texts."""
    rows = two(docs, id_col, text_col)
    kind = T.StructType([rows.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType())),
                         T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(vocabulary.value, pattern)
        for whole in batches:
            for batch in steps(whole):
                ids = _encoded(c, batch)
                got = [c.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), list_column(ids), pa.array(got, pa.binary())],
                                                 names=["id", "ids", "bytes"])

    return rows.mapInArrow(run, kind)


def with_ids(docs: DataFrame, vocabulary, pattern: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` of ``ids`` and ``text``, the text decoded from them (a column of
    that name is replaced).  The ids of a whole text decode to UTF-8."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    def run(texts: pa.Array) -> pa.Array:
        c, parts = codec(vocabulary.value, pattern, LATE_MEMO), []
        for batch in steps(pa.RecordBatch.from_arrays([texts], names=["text"])):
            ids = [c.encode(t.as_py()) if t.is_valid else b"" for t in batch.column(0)]
            got = [c.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            parts.append(pa.StructArray.from_arrays([list_column(ids), pa.array(got, pa.binary()).cast(pa.string())], names=["ids", "text"]))
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())]))

    return docs.withColumn(out, F.arrow_udf(run, kind).asNondeterministic()(F.col(f"`{text_col}`").cast("string")))
