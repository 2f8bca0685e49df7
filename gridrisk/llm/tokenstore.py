"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are put in ascending order of id (range partitions), encoded, and their ids gathered in
shards of about ``SHARD_TOKENS`` (a document is never divided).  In each shard, frequent pairs of
neighbouring ids are replaced by new ids (nonterminals), round by round, until no pair occurs ``MIN_COUNT`` times.  A
round takes the most frequent pairs that can't overlap: an id is the left part of its pairs or the
right part, never both.  Rules refer to ids of earlier rounds only.

A shard's file format, numbers little-endian:

    "RPG1", then 5 x u32: first nonterminal, rules, symbols, documents, bytes a symbol (2, 3 or 4)
    rules: left symbols, right symbols; expansion length of each rule (u32)
    the symbol sequence
    documents: ids (i64), null flags (u8), start of each in the shard's tokens and the end (u64)

Expansion lengths make any token range readable on its own (``Shard.tokens``): prefix sums find the
symbols that cover it and only those are expanded.  Shards are the rows of a Parquet table, so
they can lie in any store that Spark writes to.

Defined results: null texts count as empty; an empty document has the end id only; null ids come
first; repeated ids stay apart, in order of their texts; no documents give no shards.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import steps, two
from .pieces import TAIL, pieces

SHARD_TOKENS = 1 << 18
#: A pair is replaced if it occurs so often.
MIN_COUNT = 4
#: Pairs replaced in one round, at most; the others wait for the next.
ROUND_PAIRS = 4096
END_ID = 0
#: Pieces that a worker remembers: the last ones that were new, from so many to twice as many.
MEMO = 450_000
#: Words that the library encodes at once.
RUN = 64
#: Text bytes whose pieces are looked up together, and pieces that are made distinct together before that.
STEP = 8 << 20
CHUNK = 1 << 17
_BUCKETS = 18
#: A bucket whose pair isn't frequent, and one whose pair isn't replaced in this round.
RARE, WAITS = -2, -1

SHARDS = "part int, k int, n_docs long, n_tokens long, shard binary"
DOCUMENTS = "part int, k int, place int, id long, shard_start long, n_tokens long, ids_crc32 long"


# ---- tokens

def _kinds() -> np.ndarray:
    """Class of each byte: 1 letter, 2 closing sign, 4 space, 5 line feed, 6 other white space; 0 what else there is."""
    out = np.zeros(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        out[i] = 5 if c == "\n" else 4 if c == " " else 6 if c.isspace() else 1 if c.isalpha() else 2 if c in TAIL else 0
    return out


_KINDS = _kinds()
#: Bytes of Latin letters up to U+023F, if none of the others is near (the multiplication and division signs apart).
_LATIN = np.array([chr(i).isascii() and chr(i).isalpha() or 0x80 <= i < 0xc0 or 0xc3 <= i <= 0xc8 for i in range(256)])
#: The signs that byte-level tokenizers have for bytes, in UTF-8, with a space before that of the space; and their widths.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = [chr(b).encode() for b in range(256)]
for _i, _b in enumerate(sorted({*range(256)}.difference(_SAME))):
    _SIGNS[_b] = chr(256 + _i).encode()
_SIGNS[32] = b" " + _SIGNS[32]
_WIDTH = np.array([len(x) for x in _SIGNS])
_SIGNS = np.array([list(x.ljust(3, b" ")) for x in _SIGNS], dtype=np.uint8)
#: White space of more than one byte.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts without wide white space, and the place of each text's first among them (and their number).

    Cuts are those of ``pieces``, and one between each ASCII letter and a closing sign after it."""
    column = pa.array(texts, pa.string())
    _, offsets, body = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1) if texts else np.zeros(1, np.int32)
    if not offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, dtype=np.int64)
    kind = _KINDS[np.frombuffer(body, np.uint8, offsets[-1])]
    solid = kind < 4
    begin, end = offsets[:-1], offsets[1:]
    begin, end = begin[begin < end], end[begin < end]
    lone = np.zeros(len(kind), dtype=bool)  # has signs on both sides in its text
    lone[1:-1] = solid[:-2] & solid[2:]
    lone[begin] = lone[end - 1] = False
    line = (kind == 5) & lone
    mark = (kind == 4) & lone | line
    mark[1:] |= line[:-1] | (kind[1:] == 2) & (kind[:-1] == 1)
    mark[begin] = True
    starts = np.flatnonzero(mark)
    bounds = np.append(starts, len(kind)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), body), np.searchsorted(starts, offsets)


def _signed(words: list[str]) -> list[str]:
    """Runs of words behind a space in the tokenizer's signs, a space between two words."""
    body = np.frombuffer("".join(words).encode(), np.uint8)
    width = _WIDTH[body]
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), dtype=np.uint8)
    for k in range(3):
        has = np.flatnonzero(width > k)
        out[at[has] + k] = _SIGNS[body[has], k]
    first, text = at[np.flatnonzero(body == 32)[::RUN]].tolist(), out.tobytes()
    return [text[a + 1:b].decode() for a, b in zip(first, [*first[1:], len(text)])]


class Encoder(dict):
    """Ids of pieces by the tokenizers library, as little-endian 32-bit numbers; met pieces are remembered."""

    def __init__(self, tokenizer: str, special_text: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer)
        #: the same without the search for parts, for words of letters: they're one part each
        self.parted = None
        added, cuts = self.tokenizer.get_added_tokens_decoder().values(), self.tokenizer.pre_tokenizer
        if (isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space and self.tokenizer.normalizer is None
                and not any(t.content.replace(" ", "").isalpha() for t in added)):
            self.parted = Tokenizer(self.tokenizer.model)
            self.parted.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.tokenizer.encode_special_tokens = special_text
        self.special = [] if special_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: which tokens begin with a space
        self.leads = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), dtype=bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.startswith("Ġ")]] = True

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, met: pa.Array) -> list[bytes]:
        """Ids of each of these different pieces without wide white space."""
        pieces = met.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.get, pieces))
        unmet = [i for i, got in enumerate(out) if got is None]
        if unmet:
            new = met.take(pa.array(unmet, pa.int64()))
            ends = np.frombuffer(new.buffers()[1], np.int32, len(new) + 1 + new.offset)[new.offset:]
            body = np.frombuffer(new.buffers()[2], np.uint8, ends[-1])
            spaced = (body[ends[:-1]] == 32) & (np.diff(ends) > 1)

            def none_behind(odd: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])[ends]) == odd[ends[:-1]]

            word = spaced & none_behind(_KINDS[body] >= 4)
            odd = ~_LATIN[body]
            odd[1:] |= (body[:-1] == 0xc3) & ((body[1:] == 0x97) | (body[1:] == 0xb7))
            new = [pieces[i] for i in unmet]
            self.update(zip(new, self._new(new, word, spaced & none_behind(odd)), strict=True))
            for i, piece in zip(unmet, new, strict=True):
                out[i] = self[piece]
        return out

    def _runs(self, words: list[str], parted: bool) -> list[bytes]:
        """Ids of words behind a space, which go to the library as runs of words: that is cheaper."""
        if parted:
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.parted.encode_batch_fast(_signed(words), add_special_tokens=False)])
        else:
            ids = np.concatenate(self._library(["".join(words[i:i + RUN]) for i in range(0, len(words), RUN)]))
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(words):  # a word's first token begins with its space, no other one has a space
            return list(map(np.ndarray.tobytes, self._library(words)))
        body, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return list(map(body.__getitem__, map(slice, ends, ends[1:])))

    def _new(self, met: list[str], word: np.ndarray, letters: np.ndarray) -> list[bytes]:
        """Ids from the library; which pieces are words behind a space, and which of these have Latin letters only, is known."""
        way = np.where(letters & (self.parted is not None), 2, np.where(word, 1, 0))
        if any(" " in s for s in self.special):
            way[:] = 0
        out: list[bytes] = [b""] * len(met)
        for k in range(3):
            at = np.flatnonzero(way == k).tolist()
            if at:
                own = [met[i] for i in at]
                got = self._runs(own, k == 2) if k else map(np.ndarray.tobytes, self._library(own))
                for i, ids in zip(at, got, strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > 2 * MEMO:
            late = dict(itertools.islice(self.items(), len(self) - MEMO, None))
            self.clear()
            self.update(late)
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            out: list[bytes | None] = [None] * len(texts)
            # a text with a special token's string goes to the library whole: pieces might cut that string
            whole = [i for i, text in enumerate(texts) if any(s in text for s in self.special)]
            for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                out[i] = ids.tobytes()
            wide = [i for i, text in enumerate(texts) if out[i] is None and not text.isascii() and _WIDE.search(text)]
            parted = [pieces(texts[i]) for i in wide]
            fresh = [p for p in set().union(*parted) if p not in self]
            word = np.array([p[:1] == " " and p.split() == [p[1:]] for p in fresh], dtype=bool)
            self.update(zip(fresh, self._new(fresh, word, np.zeros(len(fresh), dtype=bool)), strict=True))
            for i, own in zip(wide, parted, strict=True):
                out[i] = b"".join(map(self.__getitem__, own))
            rest = [i for i, got in enumerate(out) if got is None]
            own, first = cut([texts[i] for i in rest])
            if not len(own):
                for i in rest:
                    out[i] = b""
                return out
            # few pieces at a time are made distinct first: their table stays in the processor's cache
            coded = pa.chunked_array([own.slice(i, CHUNK).dictionary_encode() for i in range(0, len(own), CHUNK)]).unify_dictionaries()
            met = coded.chunk(0).dictionary
            known = self._ids(met)
            ends = np.zeros(len(met) + 1, dtype=np.int64)
            np.cumsum(np.fromiter(map(len, known), np.int64, len(met)), out=ends[1:])
            known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(met), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(known))])
            ids = known.take(pa.concat_arrays([c.indices for c in coded.chunks]))
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[first].tolist()
            body = memoryview(ids.buffers()[2] or b"")
            for i, a, b in zip(rest, at, at[1:]):
                out[i] = bytes(body[a:b])
            return out
        finally:
            if collecting:
                gc.enable()


@lru_cache(maxsize=1)
def encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def load_tokenizer(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast; it has a fixed size and lies on the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


# ---- grammar

def _bits(n: int) -> int:
    return min(_BUCKETS, n.bit_length() + 2)


def _frequent(seq: np.ndarray, at: np.ndarray, min_count: int, salt: int) -> tuple[np.ndarray, ...]:
    """The places of ``at`` whose pairs may be frequent, bucket of each (the last: not counted), what is known of each
    bucket (``RARE`` or ``WAITS``), and the frequent buckets and their pairs, most frequent first.  A bucket counts for the
    last pair seen in it; with the next round's salt its others fall in other buckets."""
    bits = _bits(len(at))
    pair = seq.take(at).astype(np.uint64)
    pair <<= np.uint64(32)
    pair |= seq.take(at + 1)
    bucket = pair ^ np.uint64(salt)
    bucket *= np.uint64(0x9E3779B97F4A7C15)
    bucket >>= np.uint64(64 - bits)
    bucket = bucket.view(np.int64)
    # all pairs of a bucket that has few are rare
    may = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= min_count).take(bucket))
    at, pair, bucket = at.take(may), pair.take(may), bucket.take(may)
    held = np.empty(1 << bits, dtype=np.uint64)
    held[bucket] = pair
    bucket[held.take(bucket) != pair] = 1 << bits
    count = np.bincount(bucket, minlength=(1 << bits) + 1)
    state = np.where(count < min_count, RARE, WAITS)
    state[-1], count[-1] = WAITS, 0
    often = np.flatnonzero(count >= min_count)
    often = often[np.argsort(-count[often], kind="stable")][:ROUND_PAIRS]
    return at, bucket, state, often, held[often]


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol sequence, rules (pairs, in order of their nonterminals) and the first nonterminal.

    A round counts the pairs that are open.  One that was counted and isn't frequent is closed for good: new
    occurrences of a pair come only with a new symbol in it, all in the round that makes the symbol."""
    base = int(ids.max()) + 1 if len(ids) else 0
    seq, rules, top = ids.astype(np.uint32), [], base
    is_open, rounds = np.ones(len(seq), dtype=bool), 0
    is_open[-1:] = False  # no pair begins there
    while len(begin := np.flatnonzero(is_open)):
        rounds += 1
        is_open[begin] = False
        begin, bucket, state, often, pairs = _frequent(seq, begin, min_count, rounds * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
        side: dict[int, int] = {}
        new, taken = [], []
        left, right = (pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist()
        for b, x, y in zip(often.tolist(), left, right, strict=True):
            if x == y:
                if x in side:
                    continue
                side[x] = 2  # its pairs overlap only each other
            elif side.get(x, 0) != 0 or side.get(y, 1) != 1:
                continue
            else:
                side[x], side[y] = 0, 1
            taken.append(b)
            new.append((x, y))
        state[taken] = np.arange(top, top + len(new))
        symbol = state.take(bucket)
        is_open[begin] = symbol == WAITS
        if not new:
            continue  # pairs that shared a bucket wait for the next salt
        chosen = symbol >= 0
        at, symbol = begin[chosen], symbol[chosen]
        # in a run of one id, every second pair only
        touching = np.concatenate([[False], np.diff(at) == 1])
        if touching.any():
            first = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
            second = (np.arange(len(at)) - first) % 2 == 0
            at, symbol = at[second], symbol[second]
        seq[at] = symbol
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, is_open = seq[keep], is_open[keep]
        at -= np.arange(len(at))
        is_open[at] = True
        is_open[np.maximum(at - 1, 0)] = True
        is_open[-1:] = False
        rules += new
        top += len(new)
    return seq, np.array(rules, dtype=np.uint32).reshape(-1, 2), base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(rules), dtype=np.uint32)

    def length(symbols: np.ndarray) -> np.ndarray:
        made = symbols >= base
        return np.where(made, out[np.where(made, symbols - base, 0)], 1)

    todo = np.arange(len(rules))
    while len(todo):  # one round for each level of rules
        left, right = length(rules[todo, 0]), length(rules[todo, 1])
        ready = (left > 0) & (right > 0)
        out[todo[ready]] = (left + right)[ready]
        todo = todo[~ready]
    return out


def _pack(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpack(body: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    out[:, :width] = np.frombuffer(body, dtype=np.uint8).reshape(n, width)
    return out.view("<u4").reshape(n)


def write_shard(doc_ids: list[int | None], parts: list[bytes], min_count: int = MIN_COUNT) -> tuple[bytes, int]:
    """A shard of whole documents (each its ids as little-endian 32-bit numbers), and its number of tokens."""
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    seq, rules, base = compress(ids, min_count)
    top = base + len(rules)
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("<u8")
    body = b"".join([
        b"RPG1", struct.pack("<5I", base, len(rules), len(seq), len(doc_ids), width),
        _pack(rules[:, 0], width), _pack(rules[:, 1], width), expansion_lengths(rules, base).astype("<u4").tobytes(),
        _pack(seq, width), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
        np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(), starts.tobytes()])
    return body, len(ids)


class Shard:
    """Reader of one shard."""

    def __init__(self, body: bytes):
        if body[:4] != b"RPG1":
            raise ValueError("not a shard")
        self.base, n_rules, n_seq, n_docs, width = struct.unpack_from("<5I", body, 4)
        at = 24

        def take(n: int) -> bytes:
            nonlocal at
            at += n
            return body[at - n:at]

        left, right = (_unpack(take(n_rules * width), n_rules, width) for _ in range(2))
        self.rules = np.stack([left, right], axis=1)
        self.lengths = np.frombuffer(take(4 * n_rules), dtype="<u4")
        self.seq = _unpack(take(n_seq * width), n_seq, width)
        numbers, null = np.frombuffer(take(8 * n_docs), dtype="<i8"), np.frombuffer(take(n_docs), dtype=np.uint8)
        self.doc_ids = [None if gone else x for x, gone in zip(numbers.tolist(), null.tolist(), strict=True)]
        self.starts = np.frombuffer(take(8 * n_docs + 8), dtype="<u8").astype(np.int64)
        self.ends = np.cumsum(self._sizes(self.seq))

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        size = np.ones(len(symbols), dtype=np.int64)
        made = np.flatnonzero(symbols >= self.base)
        size[made] = self.lengths[symbols[made] - self.base]
        return size

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens go to their places at once, and nonterminals' two symbols to theirs, until no nonterminal is left."""
        size = self._sizes(symbols)
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint32)
        at = ends - size
        while len(symbols):
            made = symbols >= self.base
            out[at[~made]] = symbols[~made]
            left, right = self.rules[symbols[made] - self.base].T
            at = at[made]
            symbols, at = np.concatenate([left, right]), np.concatenate([at, at + self._sizes(left)])
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range of the shard's tokens; only symbols that cover it are expanded."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        i, j = np.searchsorted(self.ends, [start, stop - 1], side="right")
        before = int(self.ends[i - 1]) if i else 0
        return self._expand(self.seq[i:j + 1])[start - before:stop - before]

    def all_tokens(self) -> np.ndarray:
        return self._expand(self.seq)

    def document(self, place: int) -> np.ndarray:
        return self.tokens(int(self.starts[place]), int(self.starts[place + 1]))


# ---- on Spark

def shards(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID,
           shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each shard; ``part`` and ``k`` order them."""
    rows = two(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), "text"]
    # ranges of ids: a repeated id may have many rows, but they're ordered by text within one range
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(*order)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        encode, part = encoder(tokenizer.value).encode, TaskContext.get().partitionId()
        ids, parts, held, k = [], [], 0, 0

        def close():
            body, n = write_shard(ids, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([body], pa.binary())], names=["part", "k", "n_docs", "n_tokens", "shard"])

        for whole in batches:
            for batch in steps(whole, limit=STEP):
                for doc, got in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    parts.append(got + end)
                    held += len(parts[-1]) // 4
                    if held >= shard_tokens:
                        yield close()
                        ids, parts, held, k = [], [], 0, k + 1
        if ids:
            yield close()

    return rows.mapInArrow(write, SHARDS)


def write(docs: DataFrame, path: str, tokenizer, **options) -> None:
    """Write the shards of ``docs`` to ``path``, a folder that driver and executors share."""
    shards(docs, tokenizer, **options).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written store: ``id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``
    (of its ids as little-endian unsigned 32-bit numbers), and where it lies: ``part``, ``k``, ``place``."""
    stored = spark.read.schema(SHARDS).parquet(path)

    def documents(batches):
        for batch in batches:
            for part, k, body in zip(*(batch.column(i) for i in (0, 1, 2)), strict=True):
                shard = Shard(body.as_py())
                ids = shard.all_tokens().astype("<u4")
                n = len(shard.doc_ids)
                body, ends = memoryview(ids.tobytes()), (4 * shard.starts).tolist()
                crc = [zlib.crc32(body[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([k.as_py()] * n, pa.int32()),
                     pa.array(range(n), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1]),
                     pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())],
                    names=["part", "k", "place", "id", "shard_start", "n_tokens", "ids_crc32"])

    # sums over shards in two levels: one row for each part is all that one task ever orders
    sizes = stored.select("part", "k", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
                   .select("part", "k", (F.col("part_start") + F.col("before")).alias("first")))
    found = stored.select("part", "k", "shard").mapInArrow(documents, DOCUMENTS)
    return found.join(starts, ["part", "k"]).select(
        "id", (F.col("first") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "part", "k", "place")
