import random

from helpers import docs, edge_rows, empty

from gridrisk.llm import ngramjoin
from gridrisk.llm.common import Scratch, ship
from gridrisk.llm.components import connected


def sets(text, n=5):
    words = text.encode().lower().split() if text else []
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """(id, set size, component) of every row, by comparing all pairs."""
    known = [(i, sets(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in known}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for p, (i, a) in enumerate(known):
        for j, b in known[:p]:
            both = len(a & b)
            if both and 100 * both >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
                if a != b:
                    links.add(frozenset((a, b)))
    return sorted((i if i is not None else -1, len(sets(t)), root(i) if i is not None else -1) for i, t in rows), links


def result(df):
    return sorted((r["id"] if r["id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1)
                  for r in df.collect())


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz")
    boiler = " ".join(word() for _ in range(30))
    texts = []
    for size in (3, 4, 5, 6, 9, 25, 60, 120):
        for edits in (1, 3, 8):
            texts += family(rng, [word() for _ in range(size)], 12, edits)
    texts += [" ".join(word() for _ in range(rng.randint(10, 60))) + " " + boiler for _ in range(60)]
    texts += family(rng, [word() for _ in range(80)], 120, 6)  # a large family of near copies
    texts += [texts[0]] * 40 + ["", None, " \n "]
    rng.shuffle(texts)
    return [(i * 7, t if t is None or rng.random() < 0.5 else t.replace(" ", rng.choice(["  ", "\n", "\t"])).upper()) for i, t in enumerate(texts)]


def test_against_brute_force(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ngramjoin, "FREQUENT_LEAST", 4)
    rows = corpus(1)
    assert result(ngramjoin.near_duplicates(docs(spark, rows).repartition(6))) == brute(rows)[0]


def test_links_are_all_links(spark):
    ship(spark)
    rows = corpus(2)[:220]
    join = ngramjoin.Join(docs(spark, rows), Scratch(spark))
    text = dict(rows)
    of = {r["k"]: sets(text[r["id"]]) for r in join.members.collect()}
    got = [frozenset((of[r["a"]], of[r["b"]])) for r in join.links().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)[1]


def test_without_hub_rounds(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ngramjoin, "HUB_ROUNDS", 0)
    rows = corpus(3)[:200]
    assert result(ngramjoin.near_duplicates(docs(spark, rows))) == brute(rows)[0]


def test_near_copies_in_long_lists(spark):
    """A family whose copies mostly don't link: long lists, so bitmaps decide and may lose no link."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    texts = family(rng, base, 160, 9) + [" ".join(base[:k]) for k in (121, 140, 149)]
    rows = list(enumerate(texts))
    expected, links = brute(rows)
    assert 0 < len(links) < 160 * 80
    near = ngramjoin.near_duplicates(docs(spark, rows))
    assert result(near) == expected
    scratch = Scratch(spark)
    join = ngramjoin.Join(docs(spark, rows), scratch)
    assert join.links().count() == len(links)
    scratch.close()


def test_rounds_label_only_members_they_work_on(spark, monkeypatch):
    """Hub rounds on one family: the documents that share nothing are labelled once, at the end."""
    ship(spark)
    rng = random.Random(17)
    texts = family(rng, [f"w{i}" for i in range(80)], 120, 6) + [" ".join(f"x{rng.randrange(10 ** 9)}" for _ in range(12)) for _ in range(400)]
    rows, labelled, plain = list(enumerate(texts)), [], ngramjoin._labelled

    def counted(given, col, labels):
        if labels is not None and col == "k":
            labelled.append(given.count())
        return plain(given, col, labels)

    monkeypatch.setattr(ngramjoin, "_labelled", counted)
    monkeypatch.setattr(ngramjoin, "HUB_PAIRS", 1)
    assert result(ngramjoin.near_duplicates(docs(spark, rows))) == brute(rows)[0]
    assert len(labelled) > 2 and max(labelled[:-1]) <= 120 and labelled[-1] == 520


def test_bitmaps_admit_every_link():
    import numpy as np
    rng = np.random.default_rng(5)
    for n in (1, 3, 30, 146, 900, 6000):
        for _ in range(40):
            a = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, n))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(-2 ** 63, 2 ** 63 - 1, n // 10)]))
            x, y = (ngramjoin.bitmap(h, ngramjoin.SKETCH).view(np.uint64) for h in (a, b))
            both = len(np.intersect1d(a, b))
            assert ((x[:ngramjoin.FOLD] | x[ngramjoin.FOLD:]) == ngramjoin.bitmap(a, ngramjoin.FOLD).view(np.uint64)).all()
            assert both <= len(a) - sum(int(w).bit_count() for w in x & ~y)
            assert both <= len(b) - sum(int(w).bit_count() for w in y & ~x)


def test_edges(spark):
    ship(spark)
    assert result(ngramjoin.near_duplicates(docs(spark, edge_rows(), extra=True))) == brute(edge_rows())[0]
    assert ngramjoin.near_duplicates(empty(spark)).count() == 0
    assert result(ngramjoin.near_duplicates(docs(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_rows_with_one_id_are_one_document(spark):
    ship(spark)
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, "else")]
    assert result(ngramjoin.near_duplicates(docs(spark, rows))) == [(1, 16, 1), (5, 16, 1), (5, 16, 1), (7, 16, 1), (9, 1, 9)]


def test_prefix_filter_loses_nothing():
    """Any two sets that link share a prefix element, wherever frequent ones go."""
    import numpy as np
    rng = np.random.default_rng(3)
    order = ngramjoin.Order(np.arange(0, 60, 3), rng.integers(1, 9, 20))
    for _ in range(400):
        a = np.unique(rng.integers(0, 90, rng.integers(1, 40)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 90, 2)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(order.prefix(a).tolist()) & set(order.prefix(b).tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, 201), (202, 201)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 200, 201: 200, 202: 200}
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_texts_hashed_together_have_the_sets_of_each(monkeypatch):
    """Across runs of words, with words longer than a run, empty texts between, and capital ASCII letters only made small."""
    import pyarrow as pa

    monkeypatch.setattr(ngramjoin, "POWERS", 64)
    rng = random.Random(3)
    texts = ["", None, "a", "A b", "a B c\td e", "x y z w v u", "X Y z\x0bw v\x0cu", "é É " * 9, "w" * 200 + " " + "W" * 200, "\x1c a\x00b", "a b", "b a"]
    texts += [" ".join(rng.choice(["ab", "ba", "Ab", "é" * 40, "E" * 63, "漢"]) for _ in range(rng.randint(1, 40))) for _ in range(200)]

    def brute(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    got, want = ngramjoin.sets_of(pa.array(texts)), [brute(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all((x[1:] > x[:-1]).all() for x in got)
    for i, x in enumerate(got[:80]):
        for j, y in enumerate(got[:80]):
            assert len(set(x.tolist()) & set(y.tolist())) == len(want[i] & want[j])


def test_prefixes_look_up_few_shingles():
    """Frequent shingles are looked for among the least hashes; in the whole set only if too few are left there."""
    import numpy as np

    rng = np.random.default_rng(6)
    order, asked = ngramjoin.Order(np.sort(rng.integers(-2**63, 2**63 - 1, 50)), np.ones(50, dtype=int)), []
    order.__dict__["_find"] = lambda h: (asked.append(len(h)), ngramjoin.Order._find(order, h))[1]
    h = np.sort(rng.integers(-2**63, 2**63 - 1, 1000))
    assert (order.prefix(h) == h[:ngramjoin.prefix_length(1000)]).all() and sum(asked) < 300
    order.frequent = h[:900]
    order.counts = np.arange(900)
    assert order.prefix(h).tolist() == [*h[900:].tolist(), *h[:101].tolist()]
