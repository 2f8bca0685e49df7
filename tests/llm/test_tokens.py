"""Byte-level BPE and token shards, against the public tokenizer libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import docs, edge_rows, empty
from tokenizers import Tokenizer

from gridrisk.llm import bpe, tokenstore
from gridrisk.llm.common import ship
from gridrisk.llm.pieces import part_tail, pieces

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = list("ab  \n\n\t\r\x1c\x1f\x85\xa0 ​᠎　'stredll've12３½!.é漢👍́\x00<|>ǅɐ")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


def texts(n=4000):
    rng = random.Random(7)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def ids(body):
    return np.frombuffer(body, "<u4").tolist()


def test_pieces_join_to_the_text():
    for t in texts():
        assert "".join(pieces(t)) == t
        assert all("".join(part_tail(p)) == p for p in pieces(t))


def test_encode_like_the_library(codec, reference):
    for t in texts():
        assert ids(codec.encode(t)) == reference.encode_ordinary(t)
        assert codec.decode(ids(codec.encode(t))) == t.encode()


def test_long_pre_tokens(codec, reference):
    rng = random.Random(2)
    for t in ("a" * 5000, "ab" * 9000, "".join(rng.choice("abcdef") for _ in range(20_000)), "=-" * 3000):
        assert ids(codec.encode(t)) == reference.encode_ordinary(t)
    assert not codec.buckets and not any(codec.words)  # the queue is empty between pre-tokens


def test_memory_of_pieces_is_bounded(codec, monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMO", 50)
    for t in texts(800):
        assert ids(codec.encode(t)) == reference.encode_ordinary(t)
        assert len(codec) <= 50 or len(codec) > 1000  # entries of earlier tests go at the first overflow


def test_a_codec_can_remember_fewer_pieces(reference):
    with open(RANKS, "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN, memo=50)
    for t in texts(300):
        assert ids(codec.encode(t)) == reference.encode_ordinary(t)
        assert len(codec) <= 50 and len(codec.older) <= 50


def test_round_trip_frame(spark, reference):
    ship(spark)
    v = bpe.load_vocabulary(spark, RANKS)
    df = docs(spark, edge_rows(), extra=True)
    got = bpe.round_trip(df, v, public_tokenizers.PATTERN).collect()
    assert sorted((r["id"] or 0, r["ids"], bytes(r["bytes"])) for r in got) == sorted(
        (i or 0, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in edge_rows())
    coded = bpe.encode(df, v, public_tokenizers.PATTERN)
    back = bpe.decode(coded, v, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in edge_rows())
    kept = bpe.with_ids(df, v, public_tokenizers.PATTERN).collect()
    assert all(r["bpe"]["text"] == (r["text"] or "") and r["lang"] == "en" for r in kept)
    assert bpe.round_trip(empty(spark), v, public_tokenizers.PATTERN).count() == 0


def test_store_reads_back(spark, tmp_path):
    ship(spark)
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    rows = edge_rows() + [(100 + i, x) for i, x in enumerate(texts(300))]
    random.Random(3).shuffle(rows)
    path = f"{tmp_path}/store"
    tokenstore.write(docs(spark, rows, extra=True), path, tokenstore.load_tokenizer(spark, JSON), shard_tokens=2000)
    got = sorted(tokenstore.read(spark, path).collect(), key=lambda r: (r["part"], r["k"], r["place"]))
    start = 0
    for r, (i, x) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        want = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len({(r["part"], r["k"]) for r in got}) > 3


def test_store_of_nothing(spark, tmp_path):
    ship(spark)
    tokenstore.write(empty(spark), f"{tmp_path}/store", tokenstore.load_tokenizer(spark, JSON))
    assert tokenstore.read(spark, f"{tmp_path}/store").count() == 0


def test_grammar_expands_to_its_input():
    rng = random.Random(4)
    for z in ([], [5], [5] * 1001, [1, 2] * 500, [0, 0, 1] * 333, [rng.choice([3, 3, 7, 9]) for _ in range(5000)],
              [rng.randint(0, 1 << 20) for _ in range(500)] * 3):
        parts = [np.array(z[:len(z) // 3], "<u4").tobytes(), b"", np.array(z[len(z) // 3:], "<u4").tobytes()]
        body, n = tokenstore.write_shard([7, None, 9], parts)
        shard = tokenstore.Shard(body)
        assert n == len(z) and shard.all_tokens().tolist() == z and shard.doc_ids == [7, None, 9]
        assert shard.document(0).tolist() == z[:len(z) // 3] and shard.document(1).tolist() == []
        for _ in range(20):  # random access
            a, b = sorted(rng.randint(0, len(z)) for _ in range(2))
            assert shard.tokens(a, b).tolist() == z[a:b]
        assert shard.lengths.tolist() == [len(shard._expand(np.array([shard.base + i], np.uint32))) for i in range(len(shard.rules))]
    assert len(tokenstore.write_shard([1], [np.array([1, 2] * 5000, "<u4").tobytes()])[0]) < 400
    with pytest.raises(ValueError):
        tokenstore.Shard(b"none" + bytes(30))


def test_special_strings_as_the_library_reads_them(spark):
    plain = Tokenizer.from_file(JSON)
    with open(JSON, encoding="utf-8") as f:
        own = tokenstore.Encoder(f.read())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "word <|endoftext|>\n<|endoftext|>!!", "a <|endofte b", "plain words, no more"):
        got = np.frombuffer(own.encode([text, "between"])[0], dtype="<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids, text


def test_encoder_like_the_library_with_words_in_runs():
    """Also with few remembered pieces; words go to the library in runs, not as a text of its own each."""
    plain = Tokenizer.from_file(JSON)
    with open(JSON, encoding="utf-8") as f:
        own = tokenstore.Encoder(f.read())
    rng = random.Random(8)
    given = texts(1500) + ["".join(rng.choice("abyz.,'é漢 \n\t") for _ in range(40)) for _ in range(1500)] + ["", "a", " ", "\n"]
    for i in range(0, len(given), 500):
        part = given[i:i + 500]
        want = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(part)] == want
    assert own.encode([]) == []
    words, asked, library = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(600)), [], own._library
    own._library = lambda given: (asked.extend(given), library(given))[1]
    assert np.frombuffer(own.encode([words])[0], "<u4").tolist() == plain.encode(words, add_special_tokens=False).ids
    assert len(asked) < 30


def test_cuts_are_those_of_pieces():
    given = [t for t in texts() if not tokenstore._WIDE.search(t)]
    own, first = tokenstore.cut(given)
    own = own.to_pylist()
    for t, a, b in zip(given, first, first[1:], strict=False):
        assert "".join(own[a:b]) == t
        ends = {len("".join(own[a:i])) for i in range(a, b + 1)}
        assert {len("".join(pieces(t)[:i])) for i in range(len(pieces(t)) + 1)} <= ends


def test_rounds_count_open_pairs_only(monkeypatch):
    """A round of the grammar reads what the last ones left open, not the whole sequence again."""
    read, frequent = [], tokenstore._frequent
    monkeypatch.setattr(tokenstore, "_frequent", lambda seq, at, *a: (read.append(len(at)), frequent(seq, at, *a))[1])
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 60_000).clip(max=30_000).astype(np.uint32)
    seq, rules, base = tokenstore.compress(ids)
    assert len(rules) and read[0] == len(ids) - 1 and sum(read[len(read) // 2:]) < len(seq) // 2


def test_no_frequent_pair_is_left():
    rng = random.Random(11)
    for size, kinds in ((20_000, 40), (20_000, 3000), (3_000, 2)):
        seq, rules, base = tokenstore.compress(np.array([min(rng.randrange(kinds), rng.randrange(kinds)) for _ in range(size)], dtype=np.uint32))
        pairs, counts = np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:].astype(np.uint64), return_counts=True)
        assert not len(counts) or counts.max() < tokenstore.MIN_COUNT


def test_words_of_letters_are_encoded_without_the_search_for_parts():
    """Their ids are those of the whole text, next to signs, digits and letters beyond Latin too."""
    plain = Tokenizer.from_file(JSON)
    with open(JSON, encoding="utf-8") as f:
        own = tokenstore.Encoder(f.read())
    rng = random.Random(9)
    signs = "abcXYZ" * 4 + "éÀßœŁƀȿɏɐ×÷ªµ'd's1²漢ñ´.,- \ń­"
    given = [" ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(600)]
    want = [e.ids for e in plain.encode_batch(given, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(given)] == want
    words, asked, library = " ".join(f"é{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(600)), [], own._library
    own._library = lambda given: (asked.extend(given), library(given))[1]
    assert np.frombuffer(own.encode([words])[0], "<u4").tolist() == plain.encode(words, add_special_tokens=False).ids
    assert len(asked) <= 1  # the first word, which has no space before it


def test_rare_pairs_close_in_the_first_round(monkeypatch):
    """Pairs of a bucket that has few are rare, whichever of them the bucket counts for."""
    rng, opened, frequent = np.random.default_rng(4), [], tokenstore._frequent
    monkeypatch.setattr(tokenstore, "_frequent", lambda seq, at, *more: (opened.append(len(at)), frequent(seq, at, *more))[1])
    ids = rng.integers(0, 50_000, 100_000).astype(np.uint32)
    seq, rules, base = tokenstore.compress(ids)
    assert len(rules) == 0 and (seq == ids).all() and sum(opened) < 1.05 * len(ids)
