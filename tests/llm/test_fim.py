import hashlib
import random
import re

import numpy as np
from helpers import docs, edge_rows, empty
from pyspark.sql import functions as F

from gridrisk.llm import fim
from gridrisk.llm.common import ship

UNIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?。]*[\n.!?。]|[^\n.!?。]+", "word": r"[^\n \t]*[\n \t]|[^\n \t]+", "char": r"[\s\S]"}


def brute(doc_id, text, kind="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[kind], text)
    digest = hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_wavelet_matrix_against_counts():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        values = rng.integers(0, 4, n).astype(np.uint8)
        m = fim.WaveletMatrix(values)
        at = np.arange(n + 1)
        for v in range(4):
            assert (m.rank(v, at) == np.concatenate([[0], (values == v).cumsum()])).all()
            places = np.flatnonzero(values == v)
            if len(places):
                assert (m.select(v, np.arange(len(places))) == places).all()


def test_every_cut_of_every_kind():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab .!\n\té。") for _ in range(rng.choice([0, 1, 2, 7, 70, 300]))) for _ in range(60)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([len(t) for t in texts])
    for kind, pattern in UNIT.items():
        units = fim.Units(points, ends, kind)
        split = [re.findall(pattern, t) for t in texts]
        assert units.n.tolist() == [len(u) for u in split]
        for share in (0, 0.3, 0.5, 0.9, 1):
            k = np.array([int(len(u) * share) for u in split])
            assert units.cut(k).tolist() == [len("".join(u[:x])) for u, x in zip(split, k, strict=True)]


def test_frame_against_brute_force(spark):
    ship(spark)
    rows = edge_rows() + [(20, "a <P> b\nc"), (21, "a\nb<"), (22, "\n\n\n"), (23, "S>\nP>\nM>"), (24, "<<\n<<M\n>\n<S"), (25, "x\r\ny"), (26, "👍\n漢\n")]
    rows += [(100 + i, "\n".join(["<", ">", "P", "S>"][: i % 5]) + "\n" * (i % 3)) for i in range(40)]
    df = docs(spark, rows, extra=True)
    for kind, rate, spm in (("line", 100, 50), ("sentence", 60, 0), ("word", 100, 100), ("char", 100, 50)):
        out = fim.fill_in_middle(df, kind=kind, rate=rate, spm=spm)
        out = out.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
        got = sorted(((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in out), key=repr)
        want = sorted(((i, *brute(i, t, kind, rate, spm), t or "") for i, t in rows), key=repr)
        assert got == want
    assert fim.fill_in_middle(empty(spark)).count() == 0
