"""Licence scans, chat windows and link-graph filters: DataFrame expressions only."""

import random
import re
import textwrap

import pytest
from helpers import docs, edge_rows, empty
from pyspark.sql import functions as F

from gridrisk.llm import chat, licenses, linkgraph

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def pairs(t):
    w = WORD.findall(t.lower())
    return frozenset(zip(w, w[1:], strict=False))


def brute_licenses(rows, templates, threshold=licenses.THRESHOLD):
    out = {}
    for i, t in rows:
        units = set((t or "").split("\n")) | set(re.split(r"\n[ \t\r]*\n\s*", t or "")) | {t or ""}
        for u in units:
            a = pairs(u)
            scores = {}
            for name, body in templates.items():
                b = pairs(body)
                if a and b:
                    d = 2 * len(a & b) / (len(a) + len(b))
                    if d >= threshold:
                        scores[name] = d
            for name, d in scores.items():
                if d == max(scores.values()):
                    best, n = out.get((i, name), (0, 0))
                    out[i, name] = (max(best, d), n + 1)
    return {k: (round(d, 9), n) for k, (d, n) in out.items()}


def test_licenses_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                words[rng.randrange(len(words))] = "other"
            parts.append(rng.choice([" ", "  ", "\n"]).join(words).replace(",", rng.choice([",", " "])))
        rows.append((i, rng.choice(["\n", "\n\n", "\n \n"]).join(["plain text of its own", *parts])))
    got = licenses.scan(docs(spark, rows, extra=True)).collect()
    assert {(r["id"], r["license"]): (round(r["dice"], 9), r["n_units"]) for r in got} == brute_licenses(rows, licenses.TEMPLATES)
    assert len(got) > 30


def test_license_edges(spark):
    rows = [r for r in edge_rows() if r[0] != 4] + [(11, "ALL RIGHTS RESERVED"), (12, "All rights reserved.\nAll rights reserved.")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert sorted((r["id"], r["license"], r["n_units"]) for r in got) == [(11, "all-rights-reserved", 1), (12, "all-rights-reserved", 1)]
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs(spark, [(1, "one two three")]), {"x": "one two three", "y": "one", "z": ""}).first()["license"] == "x"


def published(name, width=70):
    """A whole text in lines, with a blank line before each paragraph that its capitals or numbers begin."""
    body = licenses.TEMPLATES[name]
    for mark in ("1. Redis", "2. Redis", "The above copyright notice and this permission notice shall", "THIS SOFTWARE IS", "THE SOFTWARE IS",
                 "This program is distributed", "You should have", "You may obtain", "Unless required"):
        body = body.replace(" " + mark, "\n\n" + mark)
    return "\n\n".join("\n".join(textwrap.wrap(x, width)) for x in body.split("\n\n"))


def test_whole_licence_texts_in_longer_documents(spark):
    prose = "\n\n".join(f"Paragraph {i} of a longer text that has words of its own, {i} of them new.\nAnd a second line." for i in range(20))
    head = "Copyright (c) 2020 Some Body\n\n"
    names = ["Apache-2.0-header", "BSD-2-Clause-text", "GPL-3.0-header-text", "ISC-text", "MIT-text"]
    rows, want = [], {}
    for i, name in enumerate(names):
        body = published(name)
        comment = "\n".join(f"# {x}".rstrip() for x in (head + body).split("\n"))
        for k, text in enumerate((head + body, f"{prose}\n\n{body}\n\n{prose}", f"{comment}\nimport os\nprint(os.name)\n" + "x = f(x, 1)\n" * 40,
                                  f"{prose}\n{body}\n{prose}")):
            rows.append((10 * i + k, text))
            want[10 * i + k] = name
    got = licenses.scan(docs(spark, rows, extra=True), runs=True).collect()
    found = {(r["id"], r["license"]): (r["dice"], r["n_units"]) for r in got}
    assert set(want.items()) <= found.keys()
    family = {i: name.split("-")[0] for i, name in want.items()}
    assert all(name.startswith(family[i]) for i, name in found)
    assert all(found[i, name] == (1.0, 1) for i, name in want.items() if i % 10 == 3)  # the licence's own lines and no others
    # rows that units match stay as they are
    plain = {(r["id"], r["license"]): (r["dice"], r["n_units"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert plain.items() <= found.items() and len(plain) < len(found)


def test_runs_name_the_licence_they_are_most_like(spark):
    rows = [(1, "a b\nThis work is licensed under the GNU General\nPublic License, version\n2.\nc d"), (1, None), (2, ""), (3, "\n \n"),
            (4, "All rights\n\nreserved"), (None, "x\nAll rights\nreserved\ny"), (5, "All\nrights"), (6, "This work is licensed under the GNU General Public License, version 2.\nx")]
    got = sorted(((r["id"], r["license"], r["n_units"]) for r in licenses.scan(docs(spark, rows), runs=True).collect()), key=str)
    assert got == [(1, "GPL-2.0-notice", 1), (4, "all-rights-reserved", 1), (6, "GPL-2.0-notice", 2), (None, "all-rights-reserved", 1)]
    plan = licenses.scan(docs(spark, rows), runs=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
    assert licenses.scan(empty(spark), runs=True).count() == 0


def test_no_python_in_native_plans(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a")], CONV)
    pages = spark.createDataFrame([(1, "http://a.com/", "")], PAGES)
    from gridrisk.llm.queries import RULES
    for df in (licenses.scan(docs(spark, [(1, "a b")])), chat.windows(conv), linkgraph.judge(pages, RULES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|MapIn", plan)


CONV = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"


def tokens(t):
    return -(-len(t) // 4) + chat.MARK_TOKENS


def brute_windows(rows, budget, history):
    """Per conversation: list of (turns by place, number repeated)."""
    convs, out = {}, {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    quota = max(1, budget - history)
    history = min(history, quota)
    for c, turns in convs.items():
        before, placed = 0, []
        for _, _, role, text in sorted(turns):
            n = tokens(text)
            placed.append((before // quota + (before + n - 1) // quota, before, n, role, text))
            before += n
        system = placed[0] if placed[0][3] == "system" else None
        wins = []
        for w in sorted({p[0] for p in placed}):
            own = [p for p in placed if p[0] == w]
            room = min(history, budget - sum(p[2] for p in own)) - (system[2] if system else 0)
            old = [p for p in placed if p[0] < w and p is not system and own[0][1] - p[1] <= room]
            if system and own[0][1] > 0:
                old = [system, *old]
            wins.append(([p[3:] for p in old + own], len(old)))
        out[c] = wins
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        for k in range(rng.randint(1, 12)):
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool>", None])
            rows.append((c, k * 100, role, "".join(rng.choice(["ab ", "\\", "<", ">", "#", "</turn>\n", "<turn user>", "\\l", "é漢👍"])
                                                   for _ in range(rng.randint(0, 60)))))
    rows += [(None, 1, "user", "x"), (None, 1, "assistant", "y"), (77, None, "user", None), (77, 3, "assistant", "z"),
             (77, 3, "assistant", "z"), (78, 1, "assistant", "w" * 40_000), (78, 2, "user", ""), (-5, -3, "user", "neg"), (-5, -900, "system", "s")]
    return rows


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 20), (40, 39), (10, 0), (30, 100)])
def test_windows_against_brute_force(spark, budget, history):
    rows = conversations(budget)
    df = spark.createDataFrame(rows, CONV).repartition(5).selectExpr("*", "'own' AS window", "1 AS n", "2 AS place")
    w = chat.windows(df, budget=budget, history=history)
    got = w.select("conv", "window", "n_tokens", "over_budget", chat.read_turns(F.col("text")).alias("turns"), "n_repeated",
                   chat.read_loss(F.col("text"), F.col("loss")).alias("loss")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["window"]):
        by.setdefault(r["conv"], []).append(r)
    want = brute_windows(rows, budget, history)
    assert by.keys() == want.keys()
    for c, wins in want.items():
        assert [([(t["role"], t["text"]) for t in r["turns"]], r["n_repeated"]) for r in by[c]] == wins
        for r, (turns, repeated) in zip(by[c], wins, strict=True):
            assert r["loss"] == "".join(t for role, t in turns[repeated:] if role == "assistant")
            assert r["n_tokens"] == sum(tokens(t) for _, t in turns) and r["over_budget"] == (r["n_tokens"] > budget)


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("\\\\\\<>#lgh ab\n") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    rows = df.withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r["u"] == r["t"] and not set("<>#") & set(r["e"]) for r in rows)


def test_a_very_long_conversation(spark):
    df = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    w = chat.windows(df, budget=100, history=30).collect()
    assert sum(len(r["loss"]) for r in w) == 2500 and max(r["n_tokens"] for r in w) <= 100


def test_no_conversations(spark):
    assert chat.windows(empty(spark, CONV)).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "evil.org", "/")]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_ranks(seeds, links):
    total = {}
    for (a, _), w in links.items():
        total[a] = total.get(a, 0) + w
    rank = dict(seeds)
    for _ in range(linkgraph.ITERATIONS):
        new = dict(seeds)
        for (a, b), w in links.items():
            new[b] = new.get(b, 0) + linkgraph.DAMPING * rank.get(a, 0) * w / total[a]
        rank = new
    return rank


def pages(seed=4):
    rng = random.Random(seed)
    hosts = [f"h{i}.{top}" for i in range(12) for top in ("org", "net", "com")] + ["evil.org", "a.evil.org", "example.com", "www.example.com"]
    rows = []
    for i in range(300):
        links = "".join(rng.choice([f'<a href="https://{rng.choice(hosts)}/x">', f"<img SRC='//{rng.choice(hosts).upper()}?q'>", '<a href="/own">',
                                    f"<a href=http://{rng.choice(hosts)}>"]) for _ in range(rng.randint(0, 2)))
        if i % 7 == 0:
            links += '<a href="http://evil.org/">' * 5
        rows.append((i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/a', '/es/b', '/en', '?x=/es/', '#t'])}", links))
    rows += [(900, None, None), (901, "no scheme", "<a href='//evil.org'>"), (902, "", ""), (903, "x://", "y"), (903, "x://", "y"), (None, "http://EVIL.org/a", None)]
    return rows


def brute_verdicts(rows, threshold=linkgraph.THRESHOLD):
    links, count = {}, {}
    for _, url, html in rows:
        host, path = host_path(url)
        verdict = rule_of(host, path)[1]
        if host:
            n = count.setdefault(host, [0, 0, 0])
            n[0] += 1
            n[1] += verdict == "allow"
            n[2] += verdict == "block"
        for m in re.finditer(linkgraph._LINK[4:], html or "", re.I):
            dst = m[1].lower()
            if host and dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    for _, dst in links:
        if dst not in count:
            v = rule_of(dst, "/")[1]
            count[dst] = [1, v == "allow", v == "block"]
    trust = brute_ranks({h: n[1] / n[0] for h, n in count.items()}, links)
    distrust = brute_ranks({h: n[2] / n[0] for h, n in count.items()}, {(b, a): w for (a, b), w in links.items()})
    out = []
    for i, url, _ in rows:
        host, path = host_path(url)
        rule, verdict = rule_of(host, path)
        out.append((i, host, path, rule, verdict or ("block" if distrust.get(host, 0) - trust.get(host, 0) >= threshold else "allow")))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.05])
def test_url_verdicts_against_brute_force(spark, threshold):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).repartition(4).selectExpr("*", "'own' AS host", "1 AS id", "2 AS rule")
    got = linkgraph.judge(df, RULES, threshold=threshold)
    assert sorted(((r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()), key=str) == brute_verdicts(rows, threshold)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    rows = [(1, "http://linker.org/", '<a href="http://evil.org/">'), (2, "http://friend.org/", ""), (3, "http://good.com/", '<a href="//friend.org/">')]
    got = {r["id"]: r for r in linkgraph.judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert got[1]["verdict"] == "block" and got[1]["rule"] is None and got[1]["distrust"] > 0.8
    assert got[2]["verdict"] == "allow" and got[2]["trust"] > 0.8 and got[3]["rule"] == "com/"


def test_url_edges(spark):
    assert linkgraph.judge(empty(spark, PAGES), RULES).count() == 0
    got = linkgraph.judge(spark.createDataFrame([(1, "http://a.com/x", None)], PAGES), []).first()
    assert (got["rule"], got["verdict"], got["host"], got["path"]) == (None, "allow", "a.com", "/x")


def test_license_of_texts_that_share_an_id(spark):
    unlicense, mit = licenses.TEMPLATES["Unlicense"], licenses.TEMPLATES["MIT"]
    got = licenses.scan(docs(spark, [(7, unlicense), (7, mit), (None, mit), (None, unlicense)])).collect()
    assert {(r["id"], r["license"]) for r in got} >= {(7, "Unlicense"), (7, "MIT"), (None, "MIT"), (None, "Unlicense")}


def test_ranks_on_a_cycle_have_settled(spark):
    n = 5
    links = spark.createDataFrame([(f"h{i}", f"h{(i + 1) % n}", 1.0) for i in range(n)], "src string, dst string, w double")
    seeds = spark.createDataFrame([(f"h{i}", 1.0 if i == 0 else 0.0) for i in range(n)], "host string, seed double")
    got = {r["host"]: r["rank"] for r in linkgraph.propagate(seeds, links).collect()}
    for i in range(n):  # the geometric series of all rounds trips
        assert abs(got[f"h{i}"] - 0.85 ** i / (1 - 0.85 ** n)) < 1e-3
