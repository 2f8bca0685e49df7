"""Fill-in-middle: a text's units are cut at two places and its parts reordered around marks.

The cuts are found on a wavelet matrix over character classes.  The classes of all code points of a
step of texts form one sequence; its matrix holds one bit plane per bit of the class number, each with
counts at word borders.  ``rank`` and ``select`` of a class read a few words per plane.  Ranks of a kind's
closing classes combine into the number of its boundaries before a place; the k-th boundary of a text
comes from one ``select`` where the kind has one closing class, and from a bisection on the combined
ranks where it has more.

Kinds of units: ``line`` (up to and with a line feed), ``sentence`` (up to and with ``.``, ``!``, ``?``,
``。`` or a line feed), ``word`` (up to and with a space, tab or line feed) and ``char``.  What follows the last boundary is a unit too.

Defined results: a null text counts as empty; an empty text, one that contains a mark, and one that the
rate passes over are ``plain``; their output is the text.  A null id draws as the empty string does, so
repeated rows have equal results.  Columns other than the id and the text are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, two

#: Character classes (numbers of the wavelet matrix); every other code point is OTHER.
OTHER, LINE_FEED, STOP, SPACE = 0, 1, 2, 3
CLASSES = {"\n": LINE_FEED, ".": STOP, "!": STOP, "?": STOP, "。": STOP, " ": SPACE, "\t": SPACE}
BITS = 2

#: Classes whose code points close a unit; None: every code point does.
KINDS = {"line": (LINE_FEED,), "sentence": (LINE_FEED, STOP), "word": (LINE_FEED, SPACE), "char": None}

#: Marks before the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def classes(points: np.ndarray) -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(len(points), dtype=np.uint8)
    for sign, number in CLASSES.items():
        out[points == ord(sign)] = number
    return out


class Plane:
    """One bit plane: the bits in words of 64, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def place(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero, by its word and then by bisection inside the word."""
        count = self.before if one else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(count, k, side="right") - 1
        at, rest = word << 6, k - count[word]
        bits = self.words[word] if one else ~self.words[word]
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            up = rest >= low
            rest, at = rest - np.where(up, low, 0), at + np.where(up, width, 0)
            bits = np.where(up, bits >> np.uint64(width), bits)
        return at


class WaveletMatrix:
    """Ranks and selects of the numbers under ``2 ** bits`` in a sequence."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.n, self.bits, self.planes, self.zeros = len(values), bits, [], []
        for b in reversed(range(bits)):
            bit = (values >> b & 1).astype(bool)
            self.planes.append(Plane(bit))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _bit(self, level: int, value: int) -> bool:
        return bool(value >> (self.bits - 1 - level) & 1)

    def _down(self, value: int, at: np.ndarray) -> np.ndarray:
        for level, plane in enumerate(self.planes):
            ones = plane.ones(at)
            at = self.zeros[level] + ones if self._bit(level, value) else at - ones
        return at

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each place."""
        return self._down(value, at) - self._down(value, np.zeros(1, dtype=np.int64))

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) occurrence, which must exist."""
        at = self._down(value, np.zeros(1, dtype=np.int64)) + k
        for level in reversed(range(self.bits)):
            one = self._bit(level, value)
            at = self.planes[level].place(at - self.zeros[level] if one else at, one)
        return at


class Units:
    """Boundaries of units in texts that lie one behind the other in ``points``; ``ends`` are the texts' ends."""

    def __init__(self, points: np.ndarray, ends: np.ndarray, kind: str = "line"):
        self.starts, self.ends, self.closing = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64), KINDS[kind]
        if self.closing is None:
            self.base, self.closed, self.n = self.starts, self.ends - self.starts, self.ends - self.starts
            return
        kinds = classes(points)
        self.matrix = WaveletMatrix(kinds)
        self.base = self.boundaries(self.starts)
        self.closed = self.boundaries(self.ends) - self.base
        filled = self.ends > self.starts
        open_end = np.zeros(len(ends), dtype=bool)
        open_end[filled] = ~np.isin(kinds[self.ends[filled] - 1], self.closing)
        self.n = self.closed + open_end

    def boundaries(self, at: np.ndarray) -> np.ndarray:
        """Unit ends among the code points before each place: ranks of all closing classes together."""
        return sum(self.matrix.rank(c, at) for c in self.closing)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """For each text, the code points of its first k units (k from 0 to n)."""
        if self.closing is None:
            return k
        out = np.where(k > self.closed, self.ends, self.starts)
        inside = np.flatnonzero((k > 0) & (k <= self.closed))
        if len(inside):
            nth = self.base[inside] + k[inside] - 1
            if len(self.closing) == 1:
                out[inside] = self.matrix.select(self.closing[0], nth) + 1
            else:
                low, high = self.starts[inside], self.ends[inside]  # least place with more than nth boundaries before it
                while (low < high).any():
                    middle = (low + high) >> 1
                    enough = self.boundaries(middle) > nth
                    low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
                out[inside] = low
        return out - self.starts


def draws(seed: Column) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed`` as integers."""
    digest = F.sha2(seed.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _formed(kind: str, rate: int, spm: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.string())])

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                texts = step.column("text").to_pylist()
                h = [step.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
                sizes = np.array([len(t) for t in texts], dtype=np.int64)
                units = Units(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), sizes.cumsum(), kind)
                a, b = h[0] % (units.n + 1), h[1] % (units.n + 1)
                first, second = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
                marked = np.array([PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], dtype=bool)
                plain = (sizes == 0) | marked | (h[2] % 100 >= rate)
                forms = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm")).tolist()
                out = []
                for t, f, i, j in zip(texts, forms, first.tolist(), second.tolist(), strict=True):
                    if f == "psm":
                        t = f"{PREFIX}{t[:i]}{SUFFIX}{t[j:]}{MIDDLE}{t[i:j]}"
                    elif f == "spm":
                        t = f"{SUFFIX}{t[j:]}{PREFIX}{t[:i]}{MIDDLE}{t[i:j]}"
                    out.append(t)
                yield pa.RecordBatch.from_arrays(
                    [step.column("id"), pa.array(units.n), pa.array(forms, pa.string()), pa.array(first, mask=plain),
                     pa.array(second - first, mask=plain), pa.array(out, pa.string())], schema=schema)

    return form


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", rate: int = 100,
                   spm: int = 50, seed: str = "7:") -> DataFrame:
    """One row per document: ``id``, ``n`` units, ``form``, code points of the prefix and the middle (null
    if plain) and the ``output``.  ``rate`` of 100 documents are transformed, ``spm`` of 100 of those with the
    suffix first; both draws and the cuts follow the sha256 of ``seed`` and the integer id alone."""
    rows = two(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h = draws(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.select("*", *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    return rows.mapInArrow(_formed(kind, rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form: the marks occur in no transformed text."""
    head = len(PREFIX) + 1
    body, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at = F.instr(body, second)
    left = F.substr(body, F.lit(head), at - head)
    right = F.substr(body, at + len(PREFIX))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
