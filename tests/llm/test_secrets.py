import base64
import json
import random
import time

from helpers import docs, edge_rows, empty

from gridrisk.llm import secrets
from gridrisk.llm.common import ship


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(rng, size):
    return tlv(2, b"\x01" + rng.randbytes(size))


def pkcs1(rng):
    return tlv(0x30, tlv(2, b"\0") + b"".join(number(rng, n) for n in (128, 2, 127, 63, 63, 63, 63, 63)))


def pkcs8(rng):
    return tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, rng.randbytes(32))))


def sec1(rng):
    return tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))


def openssh(rng):
    led = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + led(b"none") + led(b"none") + led(b"") + (1).to_bytes(4, "big") + led(rng.randbytes(51)) + led(rng.randbytes(136))


def url(b):
    return base64.urlsafe_b64encode(b).rstrip(b"=").decode()


def jwt(rng, alg="HS256", size=32):
    return f"{url(json.dumps({'alg': alg, 'typ': 'JWT'}).encode())}.{url(b'{\"sub\":1}')}.{url(rng.randbytes(size))}"


def pem(body, label="PRIVATE KEY", end="\n"):
    text = base64.b64encode(body).decode()
    return f"-----BEGIN {label}-----{end}" + end.join(text[i:i + 64] for i in range(0, len(text), 64)) + f"{end}-----END {label}-----"


def kinds(text):
    return [(text[a:b], k, d) for a, b, k, d in secrets.confirmed(text)]


def test_key_encodings_are_confirmed():
    rng = random.Random(1)
    for make, name in ((pkcs1, "pkcs1"), (pkcs8, "pkcs8"), (sec1, "sec1"), (openssh, "openssh")):
        body = make(rng)
        plain, hexed = base64.b64encode(body).decode(), body.hex()
        for form in (plain, hexed, hexed.upper(), base64.b64encode(plain.encode()).decode(), pem(body), pem(body, end="\\n"),
                     base64.b64encode(pem(body).encode()).decode()):
            assert kinds(f"é see {form} there") == [(form, "key", name)]
        # one byte too few or too many: the lengths no longer fill each other
        assert not kinds(base64.b64encode(body[:-1]).decode()) and not kinds((body + b"\0").hex())
        assert not kinds(base64.b64encode(rng.randbytes(len(body))).decode())
    assert not kinds(pem(pkcs8(rng), "CERTIFICATE").replace("\n", "\n ")[:-30])
    public = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(3, b"\0" + rng.randbytes(32)))
    assert not kinds(base64.b64encode(public).decode()) and not kinds(pem(public, "PUBLIC KEY"))
    web = base64.b64encode(json.dumps({"kty": "OKP", "crv": "Ed25519", "d": "x" * 20}).encode()).decode()
    assert kinds("k=" + web)[0][1:] == ("key", "jwk")


def test_token_headers_are_confirmed():
    rng = random.Random(2)
    for alg, size in (("HS256", 32), ("ES384", 96), ("RS256", 256), ("none", 0)):
        t = jwt(rng, alg, size)
        assert kinds(f"Bearer {t} x") == [(t, "token", alg)]
        assert kinds(f"token={t}") == [(t, "token", alg)]
    for wrong in (jwt(rng, "HS256", 31), jwt(rng, "XX", 32), jwt(rng)[1:], url(b'{"a":1}') + ".e30." + url(rng.randbytes(32)),
                  ".".join(url(rng.randbytes(30)) for _ in range(3)), url(b'{"alg":1}') + ".e30." + url(rng.randbytes(32))):
        assert not kinds(wrong)
    enc = ".".join([url(b'{"alg":"dir","enc":"A128GCM"}'), "", url(rng.randbytes(12)), url(rng.randbytes(40)), url(rng.randbytes(16))])
    assert not kinds(enc)  # an empty part has no place of its own; with a wrapped key it has five
    enc = ".".join([url(b'{"alg":"A128KW","enc":"A128GCM"}'), url(rng.randbytes(24)), url(rng.randbytes(12)), url(rng.randbytes(40)), url(rng.randbytes(16))])
    assert kinds(enc) == [(enc, "token", "A128KW")]


WORD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def brute(text):
    """The plain patterns by hand, place by place."""
    out, low = [], text
    i = 0
    while i < len(text):
        found = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            head = text[i:i + len(name)]
            if head.isascii() and head.lower() == name:
                j = i + len(name)
                j += text[j:j + 1] in ("'", '"') and text[j:j + 1] != ""
                while text[j:j + 1] == " ":
                    j += 1
                if text[j:j + 1] not in ("=", ":") or j >= len(text):
                    continue
                j += 1
                while text[j:j + 1] == " ":
                    j += 1
                j += text[j:j + 1] in ("'", '"') and text[j:j + 1] != ""
                k = j
                while k < len(text) and text[k] in WORD:
                    k += 1
                if k > j:
                    found = (k, k - j)
                    break
        if found:
            if found[1] >= 6:
                out.append((i, 0, found[0]))
            i = found[0]
        else:
            i += 1
    for kind, ok, start, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), (2, "0123456789abcdef", "", 24)):
        i = 0
        while i < len(low):
            j = i + len(start)
            while j < len(low) and low[j] in ok:
                j += 1
            if low.startswith(start, i) and j > i + len(start):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return [(a, secrets.KINDS[k], b) for a, k, b in sorted(out)]


def test_plain_patterns_against_brute_force(spark):
    ship(spark)
    rng = random.Random(4)
    parts = ["token", "TOKEN", "secret", "api_key", "ApiKey", "passwd", "pasſword", "password", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "AKIA" * 5,
             "0123456789abcdef", "deadbeefdeadbeef", "Z9", "\n", "é", "漢", ".", "-x", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ['token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "secret=token = abcdefgh", "token", "AKIA", ""]
    for t in texts:
        assert [(a, k, b) for a, b, k, _ in secrets.spans(t) if k in secrets.PLAIN] == brute(t), t
    rows = list(enumerate(texts))
    got = {r["id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] in secrets.PLAIN] for r in secrets.scan(docs(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}  # nothing is lost before the close look


def test_edges(spark):
    ship(spark)
    rng = random.Random(6)
    df = docs(spark, edge_rows() + [(30, jwt(rng)), (30, jwt(rng))], extra=True)
    out = secrets.scan(df).collect()
    assert len(out) == len(edge_rows()) + 2 and sum(len(r["spans"]) for r in out) == 2
    assert secrets.scan(empty(spark)).count() == 0


def test_time_follows_the_length():
    began = time.time()
    for t in ("x" * 400_000, "token " * 60_000, "e." * 200_000, "-----BEGIN A-----" * 20_000, "token" + " " * 400_000, "AKIA" * 100_000, "=" * 400_000,
              "eyJ" * 100_000 + ".e30." * 20_000, "a" * 400_000):
        secrets.spans(t)
    assert time.time() - began < 60
