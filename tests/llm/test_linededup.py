import random

import numpy as np
from helpers import docs, edge_rows, empty

from gridrisk.llm import linededup
from gridrisk.llm.common import ship


def brute(rows, window=2, long_line=40):
    """Texts after deletion, by listing every run of lines."""
    n, seen, cut = window + 1, {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        body = linededup.lines(t)
        for at in range(len(body)):
            for size in ([n] if at + n <= len(body) else []) + ([1] if len(body[at].split()) >= long_line else []):
                if seen.setdefault((size, *body[at:at + size]), (i, at)) != (i, at):
                    cut.setdefault(i, set()).update(range(at, at + size))
    out = {}
    for i, t in rows:
        if i in cut and t is not None:
            kept, k = [], -1
            for line in t.split("\n"):
                if line.strip(" \t\r\x0b\x0c"):
                    k += 1
                    if k in cut[i]:
                        continue
                kept.append(line)
            t = "\n".join(kept) if any(x.strip(" \t\r\x0b\x0c") for x in kept) else ""
        out.setdefault(i, []).append(t)
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_against_brute_force(spark):
    ship(spark)
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(12)] + ["word " * 45 + str(i) for i in range(3)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows += [(200 + i, "\n".join(f"own {i} {k}" for k in range(9))) for i in range(20)]
    got = result(linededup.dedup(docs(spark, rows).repartition(7)))
    assert got == {k: sorted(v, key=str) for k, v in brute(rows).items()}


def test_first_occurrence_stays_and_longer_runs_go_whole(spark):
    ship(spark)
    run = [f"shared {i}" for i in range(7)]
    rows = [(2, "\n".join(["a", *run, "b"])), (1, "\n".join(["c", *run])), (3, "\n".join([*run[:2], "d", *run[3:5]])), (4, "\n".join(run))]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in linededup.dedup(docs(spark, rows)).collect()}
    assert got[1] == (rows[1][1], 0) and got[2] == ("a\nb", 7) and got[3] == (rows[2][1], 0) and got[4] == ("", 7)
    found = linededup.repeated(docs(spark, rows)).filter("id = 2").collect()
    assert {(r["first_id"], r["first_at"] - r["at"]) for r in found} == {(1, 0)}


def test_repeats_within_a_document(spark):
    ship(spark)
    got = linededup.dedup(docs(spark, [(1, "a\nb\nc\nx\na\nb\nc\ny")])).first()
    assert (got["text"], got["n_deleted"]) == ("a\nb\nc\nx\ny", 3)


def brute_pairs(rows, long_line=40):
    """Texts after deletion where two lines that are long together are a run too."""
    seen, cut = {}, {}
    for i, t in sorted(rows):
        body = linededup.lines(t)
        n = [len(x.split()) for x in body]
        for at in range(len(body)):
            two = at + 2 <= len(body) and max(n[at:at + 2]) < long_line <= sum(n[at:at + 2])
            for size in [3] * (at + 3 <= len(body)) + [2] * two + [1] * (n[at] >= long_line):
                if seen.setdefault((size, *body[at:at + size]), (i, at)) != (i, at):
                    cut.setdefault(i, set()).update(range(at, at + size))
    return {i: "\n".join(x for k, x in enumerate(linededup.lines(t)) if k not in cut.get(i, ())) for i, t in rows}


def test_passages_in_two_lines(spark):
    ship(spark)
    a, b = "left " * 26 + "end", "right " * 34 + "end"
    got = result(linededup.dedup(docs(spark, [(1, f"x\n{a}\n{b}"), (2, f"{a}\n\n{b}\ny"), (3, f"u\n{a}\nv"), (4, f"{b}\n{a}\nw")])))
    assert got == {1: [f"x\n{a.strip()}\n{b.strip()}"], 2: ["\ny"], 3: [f"u\n{a}\nv"], 4: [f"{b}\n{a}\nw"]}
    rng = random.Random(3)
    pool = [f"w{k} " * n + "end" for k in range(3) for n in (1, 10, 19, 20, 30, 38, 39, 45)]
    rows = [(i, "\n".join(x.strip() for x in rng.choices(pool, k=rng.randint(1, 8)))) for i in range(200)]
    assert result(linededup.dedup(docs(spark, rows).repartition(5))) == {i: [t] for i, t in brute_pairs(rows).items()}
    assert result(linededup.dedup(docs(spark, rows), pairs=False)) == {k: sorted(v) for k, v in brute(rows).items()}


def test_edges(spark):
    ship(spark)
    got = linededup.dedup(docs(spark, edge_rows(), extra=True))
    want = {k: sorted(v, key=str) for k, v in brute(edge_rows()).items()}
    assert result(got) == want
    assert {r["id"] for r in got.collect()} == {"own"}
    assert linededup.dedup(empty(spark)).count() == 0


def test_a_line_that_all_share(spark):
    ship(spark)
    rows = [(i, f"own {i}\ncommon\nother {i}") for i in range(300)] + [(1000 + i, "head\ncommon\ntail") for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs(spark, rows)).collect()}
    assert got[5] == "own 5\ncommon\nother 5" and got[1000] == "head\ncommon\ntail" and got[1001] == ""


def test_every_run_has_a_fingerprint():
    rng = np.random.default_rng(1)
    for window in (2, 3, 5):
        for _ in range(50):
            grams = rng.integers(0, 9, rng.integers(0, 30)).astype(np.uint64)
            got = set(linededup.winnow(grams, window).tolist())
            for i in range(len(grams) - window + 1):
                low = grams[i:i + window].min()
                assert max(j for j in range(i, i + window) if grams[j] == low) in got
