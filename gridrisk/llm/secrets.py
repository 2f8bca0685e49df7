"""Secret scans with structural confirmation.

Three plain patterns give spans of their own: ``assign`` (a secret's name, a sign and a value), ``access``
(an access key's prefix) and ``hex`` (long runs of hex digits).  Beside them, long runs of base64 or hex
characters and armoured blocks are candidates: they are decoded and reported only if what they hold parses.

``token``: a signed token whose first part is a JSON header that names its algorithm, with a signature of
the length which that algorithm gives, or an encrypted token of five parts.  ``key``: a private key, i.e. DER
whose nested lengths fill each other exactly and whose members are those of a key encoding, the length-led
fields of the ``openssh-key-v1`` form, a JSON web key with its private member, or an armoured block around
one of these.  Decoded text that is encoded once more is decoded again; each layer is shorter.

All rules look at whole texts and take time in proportion to them.  Positions are code points, ends
exclusive.  Defined results: a null or empty text has no spans; repeated rows have equal spans; a candidate
that doesn't decode or parse gives none.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps, two

#: Kinds in the order of spans that start together: the plain ones, then the confirmed ones.
KINDS = ("assign", "access", "hex", "token", "key")
PLAIN = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of fewer digits are dropped anyway
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Runs that may hold a token or an encoded key, and their parts.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{24,}")
_PART = re.compile(r"[A-Za-z0-9+/_-]+")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
LEAST_ENCODED = 32

#: What a text must have somewhere to be looked at closely; every rule above implies it.
_WORTH = r"(?i:passw|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_.=-]{24}|-----BEGIN"

#: Bytes of a signature by algorithm (fixed values); None: as long as the key's modulus, 128 at least.
SIGNATURE = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,),
             "EdDSA": (64, 114), "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None, "none": (0,)}

_URL = str.maketrans("-_", "+/")
_SEQUENCE, _INTEGER, _OCTETS, _OID = 0x30, 0x02, 0x04, 0x06


def unbase64(part: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padding optional."""
    body = part.rstrip("=").translate(_URL)
    if len(body) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(body + "=" * (-len(body) % 4), strict_mode=True) if body else b""
    except (binascii.Error, ValueError):
        return None


def members(body: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill ``body[at:end]`` exactly; None if they don't."""
    out = []
    while at < end:
        if end - at < 2 or body[at] & 0x1F == 0x1F:
            return None
        tag, size, at = body[at], body[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or body[at] == 0:
                return None
            size, at = int.from_bytes(body[at:at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _algorithm(body: bytes, value: tuple[int, int, int]) -> bool:
    inner = members(body, *value[1:]) if value[0] == _SEQUENCE else None
    return bool(inner) and inner[0][0] == _OID


def der_key(body: bytes) -> str | None:
    """Name of the private-key encoding that ``body`` is."""
    outer = members(body, 0, len(body))
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return None
    inner = members(body, *outer[0][1:])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    if len(tags) == 2 and tags[1] == _OCTETS and _algorithm(body, inner[0]):
        return "pkcs8-encrypted" if inner[1][2] - inner[1][1] >= 16 else None
    version = body[inner[0][1]:inner[0][2]]
    if tags[0] != _INTEGER or version not in (b"\0", b"\1"):
        return None
    if all(t == _INTEGER for t in tags) and len(tags) in (6, 9):
        return "pkcs1" if len(tags) == 9 else "dsa"
    if len(tags) >= 3 and tags[2] == _OCTETS and _algorithm(body, inner[1]):
        return "pkcs8" if members(body, *inner[2][1:]) else None
    if version == b"\1" and len(tags) >= 2 and tags[1] == _OCTETS and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1" if inner[1][2] - inner[1][1] >= 16 else None
    return None


_SSH = b"openssh-key-v1\0"


def ssh_key(body: bytes) -> bool:
    """Whether length-led fields fill ``body``: cipher, derivation, its options, public keys, private part."""
    if not body.startswith(_SSH):
        return False
    at, left, n = len(_SSH), 3, None
    while left:
        if at + 4 > len(body):
            return False
        at += 4 + int.from_bytes(body[at:at + 4], "big")
        left -= 1
        if not left and n is None:
            n, at = int.from_bytes(body[at:at + 4], "big"), at + 4
            if not 1 <= n <= 64:
                return False
            left = n + 1
    return at == len(body)


def _json(body: bytes | None) -> dict | None:
    if not body or body[:1] != b"{":
        return None
    try:
        got = json.loads(body)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def token(parts: list[str]) -> str | None:
    """Algorithm of a signed (three parts) or encrypted (five parts) token."""
    header = _json(unbase64(parts[0]))
    if not header or not isinstance(header.get("alg"), str):
        return None
    rest = [unbase64(p) for p in parts[1:]]
    if any(r is None for r in rest):
        return None
    alg = header["alg"]
    if len(parts) == 5:
        return alg if isinstance(header.get("enc"), str) and rest[1] and rest[2] and len(rest[3]) >= 16 else None
    sizes = SIGNATURE.get(alg, ())
    right = len(rest[1]) >= 128 if sizes is None else len(rest[1]) in sizes
    return alg if right and rest[0] else None


def key(body: bytes | None) -> str | None:
    """Name of what decoded bytes hold: a key encoding, or text with a further layer around one."""
    if not body:
        return None
    name = der_key(body) or ("openssh" if ssh_key(body) else None)
    if name:
        return name
    web = _json(body)
    if web:
        return "jwk" if isinstance(web.get("kty"), str) and ("d" in web or "k" in web) else None
    if not body.isascii():
        return None
    inner = body.decode("ascii")
    found = [d for _, _, kind, d in confirmed(inner) if kind == "key"]
    return found[0] if found else None


def _armoured(label: str, body: str) -> str | None:
    if not label.endswith("PRIVATE KEY"):
        return None
    lines = body.replace("\\r", "\n").replace("\\n", "\n").split("\n")
    data = unbase64("".join(x.strip() for x in lines if ":" not in x))
    name = key(data)
    if not name and "ENCRYPTED" in body and data and len(data) % 8 == 0:
        name = "encrypted"
    return name


def confirmed(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of armoured blocks, tokens and encoded keys, ascending in each of the three."""
    blocks, opened = [], None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened and opened[2] == m[2]:
            name = _armoured(m[2], text[opened.end():m.start()])
            if name:
                blocks.append((opened.start(), m.end()))
                yield opened.start(), m.end(), "key", name
            opened = None
    at = 0
    for run in _RUN.finditer(text):
        while at < len(blocks) and blocks[at][1] <= run.start():
            at += 1
        if at < len(blocks) and blocks[at][0] <= run.start():
            continue
        parts = [(m.start() + run.start(), m.end() + run.start()) for m in _PART.finditer(run[0])]
        i = 0
        while i < len(parts):
            start, end = parts[i]
            taken, detail = _token_at(text, parts, i, run.end())
            if taken:
                yield start, taken[1], "token", detail
                i = taken[0]
                continue
            if end - start >= LEAST_ENCODED:
                part = text[start:end]
                name = None
                if len(part) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in part):
                    name = key(bytes.fromhex(part))
                pad = end
                while pad < run.end() and pad < end + 2 and text[pad] == "=":
                    pad += 1
                name, pad = (name, end) if name else (key(unbase64(part)), pad)
                if name:
                    yield start, pad, "key", name
            i += 1


def _token_at(text: str, parts: list[tuple[int, int]], i: int, end: int) -> tuple[tuple[int, int] | None, str]:
    """The part behind a token that begins at part ``i`` and the token's end; parts follow behind one dot each."""
    if text[parts[i][0]] != "e":  # no JSON object encodes to another first letter
        return None, ""
    joined = [parts[i]]
    for a, b in parts[i + 1:i + 5]:
        if a != joined[-1][1] + 1 or text[a - 1] != ".":
            break
        joined.append((a, b))
    for n in (5, 3):
        if len(joined) >= n:
            name = token([text[a:b] for a, b in joined[:n]])
            if name:
                return (i + n, joined[n - 1][1]), name
    if len(joined) == 2 and joined[1][1] < end and text[joined[1][1]] == ".":  # an empty signature
        name = token([text[a:b] for a, b in joined] + [""])
        if name:
            return (i + 2, joined[1][1] + 1), name
    return None, ""


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """All spans of a text: (start, end, kind, detail), by start and then kind as listed."""
    out = [(m.start(), m.end(), "assign", "") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), m.end(), "access", "") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", "") for m in _HEX.finditer(text)]
    out += confirmed(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("detail", T.StringType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch):
            texts = step.column("text")
            worth = pc.fill_null(pc.match_substring_regex(texts, _WORTH), False).to_pylist()
            rows = [[{"kind": k, "start": a, "end": b, "detail": d} for a, b, k, d in spans(texts[i].as_py())] if w else []
                    for i, w in enumerate(worth)]
            yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(rows, _ARROW_SPAN)], names=["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` (kind, start, end, detail) of every row, in one narrow pass."""
    rows = two(docs, id_col, text_col)
    rows = rows.select("id", rows["text"].cast("string").alias("text"))
    return rows.mapInArrow(_found, T.StructType([rows.schema["id"], T.StructField("spans", _SPAN)]))
