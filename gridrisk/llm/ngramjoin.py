"""N-gram Jaccard join: grouped prefix join over word shingles, with components of the links.

A document's set holds the 64-bit hashes of its distinct ``N``-word shingles (of its whole word sequence
if it has fewer words).  Two documents link when their sets' Jaccard similarity is at least 0.8.

* All sets are put in one global order: shingles that aren't frequent by hash, then the frequent
  ones by frequency and hash.  If two sets link, their prefixes (the first n - ceil(0.8 n) + 1) meet.
  Frequencies are counted over all documents, for the low hashes that prefixes come from and for
  whatever is common in a block of documents; the ``FREQUENT`` most frequent shingles at most are broadcast.  They only shape the order: any
  order gives the same links, so that bound loses nothing.
* Documents with equal prefixes and sizes form a group.  Groups that share a prefix shingle and pass
  the size and position filters are pairs of groups; these are expanded to their members (one for
  each distinct set, so copies never multiply) and verified on the whole sets.
* ``links`` verifies every pair of groups.  ``components`` needs no pair whose members are connected
  already: where lists are long it first pairs one group (the hub) with the others, connects what links,
  and then verifies whatever pairs still lie between different components.  So a family of many
  near copies costs about a pair a member and no link between components is lost.
* Each group in a long list also has a bitmap of its prefix.  A bit that one bitmap has and the other lacks stands for at least one
  shingle that the prefixes don't share, so a pair whose bitmaps differ too much can't link and leaves the join at
  once: near copies of one text share many shingles, and each of these would bring the pair again.  A group of one set
  also has a bitmap of this whole set there.  A larger one does the same for pairs of members before their texts are
  fetched.

Defined results: null texts and texts without words have empty sets, link with nothing and are their
own component; rows with the same id are one document, whose component joins all their texts; a null
id gets a null component and links with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let_go, list_column, steps, two
from .components import connected

N = 5
#: Least similarity, in percent.
PERCENT = 80
#: Shingles put last in the order, at most, and how often such a one occurs at least.
FREQUENT = 500_000
FREQUENT_LEAST = 32
#: Lists with more open pairs than this for each of their units are first paired with hubs, for so many
#: rounds at most; then all pairs that remain are verified.
HUB_PAIRS = 32
HUB_ROUNDS = 4
#: Documents whose ids are broadcast to fetch their texts; more are joined as the planner chooses.
FETCH_BROADCAST = 1 << 20
#: Words of 64 bits in the bitmaps of a prefix and of a whole set, and in the fold of the latter that lists carry.
BITMAP = 8
SKETCH = 32
FOLD = 16
#: Shingles counted together in a task, and how often one is common there wherever it lies in a document's order.
BLOCK = 1 << 21
BLOCK_COMMON = 4
#: Bytes whose words are hashed at once, and the longest word that isn't hashed by the library.
POWERS = 1 << 15
LONG_WORD = 32


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White space, a random number for each byte (the same for a capital ASCII letter and its small one), the powers
    of an odd number and those of its inverse."""
    white = np.zeros(256, dtype=bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    signs = np.array([xxhash.xxh3_64_intdigest(bytes([i]).lower()) for i in range(256)], dtype=np.uint64)
    signs[white] = 0
    factor = 0x9E3779B97F4A7C13
    powers, inverse = (np.full(POWERS, f, dtype=np.uint64) for f in (factor, pow(factor, -1, 1 << 64)))
    for x in (powers, inverse):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return white, signs, powers, inverse


_WHITE, _SIGNS, _POWERS, _INVERSE = _tables()


def _forget() -> None:
    """At the end of a task: a reused worker shouldn't hold an operator's memory while others run."""
    let_go()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _words(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in bytes of text.

    A word's hash is a polynomial of its bytes' numbers: a difference of two prefix sums, shifted to the word's start."""
    solid = ~_WHITE[body]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # runs of words within the powers at hand
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + POWERS, side="right")))
        size = min(int(end[to - 1]) - low, POWERS)  # less than a long word, which has a hash of its own
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_SIGNS[body[low:low + size]] * _POWERS[:size], out=sums[1:])
        a, b = start[at:to] - low, np.minimum(end[at:to] - low, size)
        out[at:to] = (sums[b] - sums[a]) * _INVERSE[a]
        at = to
    out = _mix(out ^ (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(body[start[i]:end[i]].tobytes().lower())
    return start, out


def sets_of(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The set of each text, as ascending signed 64-bit hashes; all texts are hashed together."""
    parts = [t.as_buffer() or b"" if t.is_valid else b"" for t in texts.cast(pa.binary())]
    ends = np.cumsum([0, *(len(p) + 1 for p in parts)])
    start, h = _words(np.frombuffer(b"".join(x for p in parts for x in (p, b" ")), dtype=np.uint8))
    first = np.searchsorted(start, ends)
    out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i:len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    whole, got = out.view(np.int64), []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= n:
            own = np.sort(whole[a:b - n + 1])
            distinct = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=distinct[1:])
            got.append(own if distinct.all() else own[distinct])
        elif b > a:
            own = np.full(1, b - a, dtype=np.uint64)
            for x in h[a:b]:
                own = (own ^ x) * np.uint64(0x9E3779B97F4A7C15)
                own ^= own >> np.uint64(32)
            got.append(own.view(np.int64))
        else:
            got.append(np.zeros(0, dtype=np.int64))
    return got


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def zone_length(n: int) -> int:
    """How many of the least hashes are counted: more than a prefix, as frequent ones leave it."""
    return min(n, prefix_length(n) * 5 // 4 + 8)


class Order:
    """The global order; ``frequent`` are ascending hashes with their counts."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.frequent, self.counts = frequent, counts

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return at, self.frequent[at] == h

    def prefix(self, h: np.ndarray) -> np.ndarray:
        p = prefix_length(len(h))
        if not len(self.frequent):
            return h[:p]
        least = h[:zone_length(len(h))]  # mostly enough
        first = least[~self._find(least)[1]][:p]
        if len(first) == p:
            return first
        at, often = self._find(h)
        first = h[~often][:p]
        if len(first) == p:
            return first
        late, count = h[often], self.counts[at[often]]
        return np.concatenate([first, late[np.lexsort((late, count))][:p - len(first)]])


def _zone_counts(docs: DataFrame, n: int) -> DataFrame:
    """``s`` and ``df`` of the shingles that occur in the zones of at least two documents; the count also takes in
    what lies outside the zones if it is common in a block of documents."""
    def count(batches):
        zones, sets, size = [], [], 0

        def block():
            s, c = np.unique(np.concatenate(zones), return_counts=True)
            t, d = np.unique(np.concatenate(sets), return_counts=True)
            t, d = t[d >= BLOCK_COMMON], d[d >= BLOCK_COMMON]
            # common ones with their whole count, the others with that of the zones
            alone = ~np.isin(s, t, assume_unique=True)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[alone], t])), pa.array(np.concatenate([c[alone], d]))], names=["s", "c"])

        for whole in batches:
            for batch in steps(whole):
                for h in sets_of(batch.column(0), n):
                    if len(h):
                        zones.append(h[:zone_length(len(h))])
                        sets.append(h)
                        size += len(h)
                        if size >= BLOCK:
                            yield block()
                            zones, sets, size = [], [], 0
        if sets:
            yield block()
        _forget()

    counted = docs.select("text").mapInArrow(count, "s long, c long")
    return counted.groupBy("s").agg(F.sum("c").alias("df")).filter("df > 1")


def _order(shared: DataFrame, most: int, least: int) -> Order:
    """The most frequent shingles: all from the least power of two that ``most`` allows."""
    level = F.floor(F.log2("df")).cast("int")
    levels = {r["level"]: r["n"] for r in shared.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bound, total = max([*levels, 0]) + 1, 0
    while bound > 0 and total + levels.get(bound - 1, 0) <= most and 1 << (bound - 1) >= least:
        bound -= 1
        total += levels.get(bound, 0)
    rows = shared.filter(F.col("df") >= float(1 << bound)).toArrow()
    s, df = rows.column("s").to_numpy(), rows.column("df").to_numpy()
    by = np.argsort(s)
    return Order(s[by], df[by])


def bitmap(h: np.ndarray, words: int) -> np.ndarray:
    """A bit for the low end of each hash, in so many (a power of two) signed words."""
    bits = np.zeros(64 * words, dtype=np.uint8)
    bits[h & 64 * words - 1] = 1
    return np.packbits(bits).view(np.int64)


def _long(digest: int) -> int:
    return (digest & (1 << 64) - 1) - (1 << 63)


BITS = [f"b{i}" for i in range(BITMAP)]
FOLDS = [f"f{i}" for i in range(FOLD)]
BASE = ", ".join(["n int, k long, g long, prefix binary, outside binary", *[f"{b} long" for b in BITS], "sketch array<long>"])


def _base(docs: DataFrame, order, n: int) -> DataFrame:
    """For every document: ``id``, set size ``n``, set ``k``, group ``g``, ``prefix``, its bitmap, ``outside``
    (the prefix's shingles that lie outside the document's zone) and ``sketch``, the bitmap of the whole set."""
    def run(batches):
        look = order.value
        for whole in batches:
            for batch in steps(whole):
                size, k, g, prefix, outside, bits, sketch = [], [], [], [], [], [], []
                for h in sets_of(batch.column(1), n):
                    size.append(len(h))
                    if not len(h):
                        k.append(None), g.append(None), prefix.append(None), outside.append(None), bits.append([None] * BITMAP), sketch.append(b"")
                        continue
                    p = look.prefix(h)
                    k.append(_long(xxhash.xxh3_64_intdigest(h.tobytes())))
                    g.append(_long(xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(h))))
                    prefix.append(p.tobytes())
                    bits.append(bitmap(p, BITMAP).tolist())
                    sketch.append(bitmap(h, SKETCH).tobytes())
                    out = p[p > h[zone_length(len(h)) - 1]]
                    outside.append(out.tobytes() if len(out) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size, pa.int32()), pa.array(k, pa.int64()), pa.array(g, pa.int64()),
                     pa.array(prefix, pa.binary()), pa.array(outside, pa.binary()),
                     *(pa.array(b, pa.int64()) for b in zip(*bits, strict=True)), list_column(sketch, np.int64)],
                    names=["id", "n", "k", "g", "prefix", "outside", *BITS, "sketch"])
        _forget()

    kind = docs.select("id").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    return docs.select("id", "text").mapInArrow(run, f"{kind}, {BASE}")


def _spread(rows: DataFrame, keep: list[str], body: str) -> DataFrame:
    """A row for each hash in a binary column: the kept columns, ``s`` and its place ``pos``."""
    def run(batches):
        for batch in batches:
            for part in steps(batch, body):
                got = [np.frombuffer(x.as_py(), dtype=np.int64) for x in part.column(len(keep))]
                if not got:
                    continue
                size = np.array([len(x) for x in got])
                of = pa.array(np.repeat(np.arange(len(got)), size))
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(of) for i in range(len(keep))), pa.array(np.concatenate(got)),
                     pa.array(pos.astype(np.int32))], names=[*keep, "s", "pos"])

    kind = rows.select(*keep).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    return rows.select(*keep, body).mapInArrow(run, f"{kind + ', ' if keep else ''}s long, pos int")


def may_link(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Size and position filters for two sets that share the shingle at these places of their prefixes."""
    size = (100 * n >= PERCENT * other_n) & (100 * other_n >= PERCENT * n)
    most = F.least(pos, other_pos) + 1 + F.least(n - pos, other_n - other_pos) - 1
    return size & ((100 + PERCENT) * most >= PERCENT * (n + other_n))


def may_overlap(x: str, y: str) -> Column:
    """Whether two units can link by what the bitmaps of their prefixes, and those of their whole sets, don't have in
    common; without bitmaps they can."""
    def alone(unit: str, other: str, bits: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"{unit}_{b}").bitwiseAND(F.bitwise_not(F.col(f"{other}_{b}")))) for b in bits), F.lit(0))

    def admits(n: Column, other_n: Column, bits: list[str], more: Column) -> Column:
        most = F.least(n - alone(x, y, bits), other_n - alone(y, x, bits)) + more
        return F.coalesce((100 + PERCENT) * most >= PERCENT * (F.col(f"{x}_n") + F.col(f"{y}_n")), F.lit(True))

    n, other_n = F.col(f"{x}_n"), F.col(f"{y}_n")
    return admits(n - _rest(n), other_n - _rest(other_n), BITS, _rest(F.greatest(n, other_n))) & admits(n, other_n, FOLDS, F.lit(0))


def may_match(n: Column, sketch: Column, other_n: Column, other_sketch: Column) -> Column:
    """Whether two sets can link by what their bitmaps don't have in common."""
    def shared(n: Column, own: Column, other: Column) -> Column:
        alone = F.zip_with(own, other, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))))
        return n - F.aggregate(alone, F.lit(0), lambda x, y: x + y)

    most = F.least(shared(n, sketch, other_sketch), shared(other_n, other_sketch, sketch))
    return (100 + PERCENT) * most >= PERCENT * (n + other_n)


def _rest(n: Column) -> Column:
    """The size without the prefix."""
    return F.ceil(F.lit(PERCENT) * n / 100) - 1


class Join:
    """The tables of one join: documents, sets, groups and the lists of groups that share a shingle."""

    def __init__(self, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", n: int = N):
        self.n, self.scratch = n, scratch
        table = scratch.table
        self.docs = two(docs, id_col, text_col)
        known = self.docs.filter("id is not null")
        shared = table(_zone_counts(known, n))
        order = docs.sparkSession.sparkContext.broadcast(_order(shared, FREQUENT, FREQUENT_LEAST))
        self.base = table(_base(known, order, n))
        sets = self.base.filter("n > 0")
        #: a row for each distinct set
        self.members = table(sets.groupBy("k").agg(F.min("id").alias("id"), F.min("g").alias("g"), F.min("n").alias("n"),
                                                     *[F.min(b).alias(b) for b in BITS]))
        groups = sets.groupBy("g").agg(F.min("n").alias("n"), F.min("prefix").alias("prefix"))
        postings = _spread(groups, ["g", "n"], "prefix")
        # a shingle that two prefixes share was counted twice, or lies outside the zone of one of them
        outside = _spread(sets.filter("outside is not null"), [], "outside").select("s").distinct()
        can_meet = shared.select("s").unionByName(outside).distinct()
        postings = table(postings.join(can_meet, "s", "left_semi"))
        lists = postings.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("s")
        #: groups by shared shingle: list ``s``, unit ``u``, its size and the shingle's place in its prefix
        self.lists = table(postings.join(lists, "s").select("s", F.col("g").alias("u"), "n", "pos"))
        several = self.members.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g")
        #: members by group, as lists of the same shape
        self.within = table(self.members.join(several, "g").select(F.col("g").alias("s"), F.col("k").alias("u"), "n", F.lit(0).alias("pos")))

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``k`` and the whole set of the members whose ``k`` is wanted (a table)."""
        ids = self.members.join(wanted, "k").select("id", "k")
        if wanted.count() <= FETCH_BROADCAST:
            ids = F.broadcast(ids)
        n = self.n

        def run(batches):
            for whole in batches:
                for batch in steps(whole, limit=1 << 20):
                    got = [h.tobytes() for h in sets_of(batch.column(0), n)]
                    # an id that has several texts brings sets that aren't wanted
                    own = pa.array([_long(xxhash.xxh3_64_intdigest(x)) == k for x, k in zip(got, batch.column(1).to_pylist(), strict=True)])
                    yield pa.RecordBatch.from_arrays([batch.column(1).filter(own), pa.array(got, pa.binary()).filter(own)], names=["k", "body"])
            _forget()

        return self.scratch.table(self.docs.join(ids, "id").select("text", "k").mapInArrow(run, "k long, body binary"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs of members (``a``, ``b``, a table) whose whole sets are similar enough."""
        wanted = self.scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct())
        sets = self._sets(wanted)

        def run(batches):
            for batch in batches:
                a, b, x, y = (batch.column(i) for i in range(4))
                ok = []
                for p, q in zip(x, y, strict=True):
                    p, q = np.frombuffer(p.as_py(), dtype=np.int64), np.frombuffer(q.as_py(), dtype=np.int64)
                    if len(p) > len(q):
                        p, q = q, p
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

        both = pairs.join(sets.select(F.col("k").alias("a"), F.col("body").alias("x")), "a")
        both = both.join(sets.select(F.col("k").alias("b"), F.col("body").alias("y")), "b")
        return self.scratch.table(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))

    def _expand(self, units: DataFrame, labels: DataFrame | None, all_members: bool) -> DataFrame:
        """Pairs of groups as pairs of members of different components: all of them that their bitmaps admit, or one
        for each component that a group has a member in."""
        units = self.scratch.table(units)
        met = self._members_of(units.select(F.explode(F.array("x", "y")).alias("g")), "n")
        if all_members:
            m = self.scratch.table(_labelled(met.join(self._sketches(met), "k"), "k", labels))
        else:
            m = _labelled(met, "k", labels).groupBy("g", "label").agg(F.min("k").alias("k"))

        def side(unit: str, member: str) -> DataFrame:
            return m.select(F.col("g").alias(unit), *[F.col(c).alias(member if c == "k" else f"{member}_{c}") for c in m.columns if c != "g"])

        pairs = units.join(side("x", "a"), "x").join(side("y", "b"), "y").filter("a_label != b_label")
        if all_members:
            pairs = pairs.filter(may_match(F.col("a_n"), F.col("a_sketch"), F.col("b_n"), F.col("b_sketch")))
        return pairs.select("a", "b")

    def links(self) -> DataFrame:
        """Every link between different sets: ``a``, ``b`` (their ``k``; ``members`` and ``base`` have the documents)."""
        inner = _crossing(self.within.withColumn("label", F.col("u")), False).select(F.col("x").alias("a"), F.col("y").alias("b"))
        outer = self._expand(_crossing(self._signed(self.lists.withColumn("label", F.col("u"))), True), None, True)
        return self.verify(self.scratch.table(_ordered(outer.unionByName(inner)).distinct())).distinct()

    def components(self) -> DataFrame:
        """``node`` (a set's ``k``) and ``label`` of the sets that link with another one."""
        labels, found, tested = None, [], []

        def step(pairs: DataFrame) -> DataFrame:
            pairs = _ordered(pairs).distinct()
            for old in tested:
                pairs = pairs.join(old, ["a", "b"], "left_anti")
            tested.append(self.scratch.table(pairs))
            found.append(self.verify(tested[-1]))
            links = found[0]
            for more in found[1:]:
                links = links.unionByName(more)
            return connected(links, self.scratch)

        # long lists first: their units meet hubs until few pairs are open
        long = [self.scratch.table(_long_lists(x.withColumn("label", F.col("u")))) for x in (self.within, self.lists)]
        for i in range(HUB_ROUNDS):
            if i > 1 and 10 * found[-1].count() < tested[-1].count():
                break  # few of the last pairs linked: hubs don't help
            inner, outer = (x.drop("label") for x in long)
            inner, outer = _labelled(inner, "u", labels), outer.join(self._group_labels(outer, labels), "u")
            long = [self.scratch.table(_long_lists(self.scratch.table(x))) for x in (inner, outer)]
            if not any(x.limit(1).count() for x in long):
                break
            inner, outer = (_hub_pairs(x, i) for x in long)
            labels = step(inner.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(self._expand(outer, labels, False)))
        inner = self.scratch.table(_labelled(self.within, "u", labels))
        outer = self._signed(self.scratch.table(self.lists.join(self._group_labels(self.lists, labels), "u")))
        inner, outer = _crossing(inner, False), _crossing(outer, True)
        return step(inner.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(self._expand(outer, labels, True)))

    def _sketches(self, wanted: DataFrame) -> DataFrame:
        """``k`` and the bitmap of the whole set of the members whose ``k`` is wanted."""
        return self.base.select("k", "sketch").join(wanted.select("k"), "k", "left_semi").dropDuplicates(["k"])

    def _signed(self, lists: DataFrame) -> DataFrame:
        """The lists with their units' bitmaps; those of lists that aren't long stay null, and those of whole sets
        where a group has several sets."""
        long = self.scratch.table(_long_lists(lists))
        only = F.when(F.count(F.lit(1)) == 1, F.min("k")).alias("k")
        bits = self.members.groupBy(F.col("g").alias("u")).agg(only, *[F.min(b).alias(b) for b in BITS])
        bits = self.scratch.table(bits.join(long.select("u").distinct(), "u", "left_semi"))
        # bit i of the fold stands for the bits i and i + 64 FOLD of the sketch
        folds = [F.col("sketch")[i].bitwiseOR(F.col("sketch")[i + FOLD]).alias(f) for i, f in enumerate(FOLDS)]
        bits = bits.join(self._sketches(bits), "k", "left").select("u", *BITS, *folds)
        long = self.scratch.table(long.join(bits, "u"))
        rest = lists.join(long.select("s").distinct(), "s", "left_anti")
        return self.scratch.table(rest.unionByName(long, allowMissingColumns=True))

    def _members_of(self, groups: DataFrame, *more: str) -> DataFrame:
        """``k``, ``g`` and ``more`` of the members of the groups in column ``g``, so that what a round joins follows
        the groups it works on and not all documents."""
        return self.members.select("k", "g", *more).join(groups.distinct(), "g", "left_semi")

    def _group_labels(self, lists: DataFrame, labels: DataFrame | None) -> DataFrame:
        """For the groups in ``lists`` the component that all members of a group are in; null if they're in several."""
        members = self._members_of(lists.select(F.col("u").alias("g")))
        groups = _labelled(members, "k", labels).groupBy(F.col("g").alias("u")).agg(
            F.min("label").alias("low"), F.max("label").alias("high"))
        return groups.select("u", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b")


def _labelled(rows: DataFrame, col: str, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of the member in ``col``: its own ``k`` if it has no link yet."""
    if labels is None:
        return rows.withColumn("label", F.col(col))
    return rows.join(labels.withColumnRenamed("node", col), col, "left").withColumn("label", F.coalesce("label", col))


def _pairs(left: DataFrame, right: DataFrame, more: str, shared: bool = False) -> DataFrame:
    """Distinct pairs of units ``x``, ``y`` that have a list in common and pass the filters and ``more``.

    ``shared``: the lists hold every shingle that the units' prefixes share, so their number limits the
    overlap too: what the prefixes don't share lies behind the end of one of them."""
    def side(lists: DataFrame, unit: str) -> DataFrame:
        return lists.select("s", *[F.col(c).alias(unit if c == "u" else f"{unit}_{c}") for c in lists.columns if c != "s"])

    pairs = side(left, "x").join(side(right, "y"), "s").filter(more)
    pairs = pairs.filter(may_link(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos")))
    if not shared:
        return pairs.select("x", "y").distinct()
    pairs = pairs.filter(may_overlap("x", "y"))
    # either unit may be x, from list to list
    both = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.greatest("x_n", "y_n").alias("most"),
                        (F.col("x_n") + F.col("y_n")).alias("total"))
    both = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min("most").alias("most"), F.min("total").alias("total"))
    return both.filter((100 + PERCENT) * (F.col("c") + _rest(F.col("most"))) >= PERCENT * F.col("total")).select("x", "y")


def _long_lists(lists: DataFrame) -> DataFrame:
    """The lists with more than ``HUB_PAIRS`` open pairs for each unit; a pair is open if its units aren't in one
    component (label null: several)."""
    part = lists.groupBy("s", "label").agg(F.count(F.lit(1)).cast("double").alias("c"))
    same = F.when(F.col("label").isNotNull(), F.col("c") * F.col("c")).otherwise(F.col("c"))
    part = part.groupBy("s").agg(F.sum("c").alias("c"), F.sum(same).alias("same"))
    return lists.join(part.filter((F.col("c") * F.col("c") - F.col("same")) / 2 > HUB_PAIRS * F.col("c")).select("s"), "s")


_DIFFER = "x != y and coalesce(x_label != y_label, true)"


def _with_main(lists: DataFrame) -> DataFrame:
    """The lists whose units are in several components, with the largest one's label ``main``."""
    part = lists.groupBy("s", "label").agg(F.count(F.lit(1)).alias("c"))
    main = part.groupBy("s").agg(F.max(F.when(F.col("label").isNotNull(), F.struct("c", "label"))).alias("m"), F.sum("c").alias("c"))
    return lists.join(main.filter("m is null or m.c < c").select("s", F.col("m.label").alias("main")), "s")


def _hub_pairs(lists: DataFrame, i: int) -> DataFrame:
    """Each list's units with its hub for this round, one hub for each class of sizes that may link.

    The first round's hubs are the same in lists of the same units; later ones differ from list to list and
    come from the list's largest component, so that what is left meets many of its members."""
    lists = lists.withColumn("class", F.floor(F.log("n") / float(np.log(100 / PERCENT))))
    hash_ = F.xxhash64("u", F.lit(i))
    if i:
        lists = _with_main(lists)
        hash_ = F.struct(F.coalesce(F.col("label") != F.col("main"), F.lit(True)), F.xxhash64("u", "s", F.lit(i)))
    pick = F.struct(hash_.alias("o"), "u", "n", "pos", "label")
    hubs = lists.groupBy("s", "class").agg(F.min(pick).alias("h")).select("s", "class", "h.u", "h.n", "h.pos", "h.label")
    return _pairs(lists.select("s", "class", "u", "n", "pos", "label"), hubs, f"x_class = y_class and {_DIFFER}")


def _crossing(lists: DataFrame, shared: bool) -> DataFrame:
    """All pairs but those in one component.

    In each list the units of its largest component meet only the others, and those each other."""
    lists = _with_main(lists).withColumn("minor", F.coalesce(F.col("label") != F.col("main"), F.lit(True))).drop("main")
    return _pairs(lists.filter("minor"), lists, f"(x < y or not y_minor) and {_DIFFER}", shared)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """A row for every row of ``docs``: ``id``, ``n_shingles`` and ``component_id``, the least id reachable by links.

    The result is a table in the shared checkpoint folder; the tables of the steps are deleted."""
    scratch, result = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    try:
        join = Join(docs, scratch, id_col, text_col, n)
        labels = join.components()
        rows = scratch.table(_labelled(join.base.select("id", "n", "k"), "k", labels).select("id", "n", F.col("label").alias("c")))
        least = rows.groupBy("c").agg(F.min("id").alias("least"))
        rows = scratch.table(rows.join(least, "c", "left").select("id", "n", F.coalesce("least", "id").alias("component_id")))
        # rows that share an id are one document: the components of its texts are one
        split = rows.groupBy("id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).filter("low != high")
        if split.limit(1).count():
            joined = connected(rows.select(F.col("id").alias("a"), F.col("component_id").alias("b")), scratch)
            rows = rows.join(joined, rows["component_id"] == joined["node"]).select("id", "n", F.col("label").alias("component_id"))
        out = rows.select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        # null ids took no part: their size is known, their component isn't
        lone = docs.filter(F.col(f"`{id_col}`").isNull())
        return result.table(out.unionByName(_lone(two(lone, id_col, text_col), n)))
    finally:
        scratch.close()


def _lone(rows: DataFrame, n: int) -> DataFrame:
    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([len(h) for h in sets_of(texts, n)], pa.int64())

    return rows.select("id", size("text").alias("n_shingles"), F.col("id").alias("component_id"))
