"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line with its line feed; long paragraphs are cut into pieces at spaces chosen by
the bytes before them (content-defined, so an edit moves no distant cut), pieces of over
``MAX_PIECE`` bytes at fixed steps.  Paragraphs form sections, which end at a blank line or after a
paragraph whose hash says so.  Each node's hash is the hash of its children's; the root is 128 bits.

The fingerprint is the tree as text: ``root/bytes``, then ``hash.bytes`` of each section behind a
``|``, of each paragraph behind a ``;`` and of each piece behind a ``,`` (a paragraph of one piece is
that piece).  Equal texts have equal fingerprints.  Two fingerprints with equal roots are alike by 1; else only differing branches are
opened, and likeness is twice the bytes of common branches over the bytes of both.

Defined results: a null text counts as empty; the empty text has a root and no branch; two empty
texts are alike by 1, an empty and another by 0.  Repeated rows get equal fingerprints.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, steps

MAX_PIECE = 128
#: One space in so many ends a piece, one paragraph in so many ends a section (powers of two).
PIECE_SPACES = 8
SECTION_PARAGRAPHS = 8

_digest = xxhash.xxh3_64_intdigest


def _cuts(body: bytes) -> np.ndarray:
    """Ends of pieces, ascending; every line feed is one."""
    b = np.frombuffer(body, dtype=np.uint8)
    line = b == 0x0A
    space = np.flatnonzero(b == 0x20)
    space = space[space >= 4]
    mix = np.zeros(len(space), dtype=np.uint32)
    for back in (4, 3, 2, 1):
        mix = (mix + b[space - back]) * np.uint32(0x9E3779B1)
    chosen = space[mix >> np.uint32(32 - PIECE_SPACES.bit_length() + 1) == 0]
    ends = np.concatenate([chosen + 1, np.flatnonzero(line) + 1, [len(b)]])
    ends = np.unique(ends)
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > MAX_PIECE)
    if len(long):
        more = [np.arange(starts[i] + MAX_PIECE, ends[i], MAX_PIECE) for i in long]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def tree(text: str | None) -> str:
    """The fingerprint of one text."""
    body = (text or "").encode("utf-8", "surrogatepass")
    if not body:
        return f"{xxhash.xxh3_128_hexdigest(b'')}/0"
    sections: list[str] = []
    section, paragraph = [], []  # the section's paragraphs and the paragraph's pieces, as text
    hashes, paragraph_hashes, root = b"", b"", b""
    at = section_at = paragraph_at = 0
    for end in _cuts(body).tolist():
        piece = body[at:end]
        h = _digest(piece)
        hashes += h.to_bytes(8, "little")
        paragraph.append(f",{h & 0xFFFFFFFF:08x}.{end - at:x}")
        at = end
        last = at == len(body)
        if piece[-1] == 0x0A or last:
            blank = len(paragraph) == 1 and not piece.strip()
            if len(paragraph) > 1:
                h = _digest(hashes)
            else:
                paragraph = []
            paragraph_hashes += h.to_bytes(8, "little")
            section.append(f";{h & 0xFFFFFFFF:08x}.{at - paragraph_at:x}{''.join(paragraph)}")
            paragraph, hashes, paragraph_at = [], b"", at
            if blank or last or h >> 32 & (SECTION_PARAGRAPHS - 1) == 0:
                h = _digest(paragraph_hashes)
                root += h.to_bytes(8, "little")
                sections.append(f"|{h & 0xFFFFFFFF:08x}.{at - section_at:x}{''.join(section)}")
                section, paragraph_hashes, section_at = [], b"", at
    return f"{xxhash.xxh3_128_hexdigest(root)}/{len(body)}{''.join(sections)}"


def _sections(fingerprint: str) -> list[str]:
    return fingerprint.split("|")[1:]


def _paragraphs(section: str) -> list[str]:
    return section.split(";")[1:]


def _pieces(paragraph: str) -> list[str]:
    head, *pieces = paragraph.split(",")
    return pieces or [head]


def _open(a: list[str], b: list[str], sign: str) -> tuple[list[str], list[str], int]:
    """Branches of either side that the other lacks, and the bytes of those that both have."""
    heads_a, heads_b = [x.partition(sign)[0] for x in a], [x.partition(sign)[0] for x in b]
    common = Counter(heads_a) & Counter(heads_b)
    if not common:
        return a, b, 0
    size = sum(int(head[9:], 16) * n for head, n in common.items())
    rest = []
    for branches, heads in ((a, heads_a), (b, heads_b)):
        left, own = common.copy(), []
        for branch, head in zip(branches, heads, strict=True):
            if left[head] > 0:
                left[head] -= 1
            else:
                own.append(branch)
        rest.append(own)
    return rest[0], rest[1], size


def likeness(a: str | None, b: str | None) -> float:
    """0 to 1 for two fingerprints; a null one is like nothing."""
    if a is None or b is None:
        return 0.0
    head_a, head_b = a.partition("|")[0], b.partition("|")[0]
    if head_a == head_b:
        return 1.0
    total = int(head_a.partition("/")[2]) + int(head_b.partition("/")[2])
    left, right, common = _open(_sections(a), _sections(b), ";")
    left, right, more = _open([p for s in left for p in _paragraphs(s)], [p for s in right for p in _paragraphs(s)], ",")
    common += more
    *_, more = _open([x for p in left for x in _pieces(p)], [x for p in right for x in _pieces(p)], ",")
    return min(1.0, 2.0 * (common + more) / total)


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the first text whose pieces the second lacks, found through differing branches."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    have_sections = Counter(s.partition(";")[0] for s in _sections(b))
    have = Counter(x for s in _sections(b) for p in _paragraphs(s) for x in _pieces(p))
    found, at = [], 0
    for section in _sections(a):
        head = section.partition(";")[0]
        if have_sections[head] > 0:
            have_sections[head] -= 1
            at += int(head[9:], 16)
            continue
        for piece in (x for p in _paragraphs(section) for x in _pieces(p)):
            n = int(piece[9:], 16)
            if have[piece] > 0:
                have[piece] -= 1
            elif found and found[-1][1] == at:
                found[-1] = (found[-1][0], at + n)
            else:
                found.append((at, at + n))
            at += n
    return found


@F.arrow_udf(T.StringType())
def _tree(texts: pa.Array) -> pa.Array:
    return pa.array([tree(t.as_py()) for t in texts], pa.string())


@F.arrow_udf(T.DoubleType())
def like(a: pa.Array, b: pa.Array) -> pa.Array:
    """Likeness of two columns of fingerprints."""
    return pa.array([likeness(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())


_tree = _tree.asNondeterministic()


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of each text (a column named ``out`` is replaced)."""
    return docs.withColumn(out, _tree(F.col(f"`{text_col}`").cast("string")))


def compared(rows: DataFrame, text: str, others: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows``, the ``fingerprint`` of the column ``text`` and, for each of ``others``, its
    ``<other>_fingerprint`` and ``near_<other>``, its likeness to the first.  All trees of a row are made in one pass of bounded
    steps, which holds no text longer than it takes to hash it."""
    names = [f"{o}_fingerprint" for o in others] + [f"near_{o}" for o in others]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("fingerprint", T.StringType()),
                           *[T.StructField(n, T.DoubleType() if n.startswith("near_") else T.StringType()) for n in names]])

    def run(batches):
        for batch in batches:
            for step in steps(batch, text, STEP_BYTES // (1 + len(others))):
                own = [tree(t.as_py()) for t in step.column(text)]
                made = [[tree(t.as_py()) for t in step.column(o)] for o in others]
                near = [[likeness(a, b) for a, b in zip(own, m, strict=True)] for m in made]
                yield pa.RecordBatch.from_arrays(
                    [*[step.column(c) for c in keep], pa.array(own, pa.string()), *[pa.array(m, pa.string()) for m in made],
                     *[pa.array(n, pa.float64()) for n in near]], names=schema.names)
        pa.default_memory_pool().release_unused()

    return rows.select(*keep, text, *others).mapInArrow(run, schema)
