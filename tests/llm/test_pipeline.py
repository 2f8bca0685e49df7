"""The pipeline against stages written down plainly, and its edges."""

import random

import corpus_pipeline
import public_tokenizers
from helpers import docs, edge_rows, empty
from test_decontaminate import brute as brute_hits
from test_linededup import brute as brute_lines
from test_ngramjoin import brute as brute_near

from gridrisk.llm import langid
from gridrisk.llm.queries import held_out  # noqa: F401


def write_tables(spark, folder, rows, items):
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnr") + rng.choice("aeiou")
    line = lambda n=9: " ".join(word() for _ in range(n))
    items = [(i, line(rng.choice([12, 20, 4]))) for i in range(6)]
    texts = ["\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(80)]
    near = line(60)
    texts += [texts[3], near, near + " more"] + [f"{line(30)} {t} {line(10)}" for _, t in items]
    texts += ["\n".join([line(), *texts[7].split("\n")[:5], line()]), "12 34 !!", ""]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, line(20))], items


def test_run_against_plain_stages(spark, tmp_path):
    rows, items = corpus()
    write_tables(spark, tmp_path, rows, items)
    got = corpus_pipeline.run(spark, str(tmp_path))
    model = langid.train(docs(spark, rows))
    judge = langid.Classifier(model).judge
    kept = []
    for i, t in rows:
        lang, score = judge(t)
        if lang != "und" and score >= langid.REJECT_MARGIN:
            kept.append((i, t))
    cut = brute_lines(kept)
    kept = [(i, cut[i][0]) for i, t in kept if cut[i][0] != "" or t == ""]
    near = brute_near(kept)[0]
    first = {i for i, _, c in near if i == c}
    kept = [(i, t) for i, t in kept if i is None or i in first]
    out = {}
    full = {i: h for i, _, h, _ in brute_hits(kept, [x for x in items if len(x[1].split()) >= 10])}
    short = {i: h for i, _, h, _ in brute_hits(kept, [x for x in items if len(x[1].split()) < 10])}
    for i, t in kept:
        if not full[i]:
            out[i] = (t, short[i])
    result = {r["doc_id"]: r for r in got.collect()}
    assert result.keys() == out.keys() and len(out) < len(rows)
    from gridrisk.llm import bpe
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    for i, (t, hits) in out.items():
        r = result[i]
        assert codec.decode(r["ids"]).decode() == r["text"] and r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"])
        if not hits:
            assert r["text"] == t
        else:
            assert len(r["text"].split()) == len(t.split()) - hits
    assert not any(i in result for i in (500, 80, 82))  # null, exact copy, near copy


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    write_tables(spark, tmp_path, rows, items)
    d = docs(spark, rows + edge_rows(), extra=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        assert {r["id"] for r in out.select("id").distinct().collect()} <= {"own"}
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name


def test_tasks_take_one_python_worker(spark, tmp_path):
    """A task with two Python steps holds two workers, and idle ones take turns: four vocabularies on two cores."""
    rows, items = corpus()
    write_tables(spark, tmp_path, rows, items)
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs(spark, rows), str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        steps = [x for x in plan.splitlines() if "ArrowEvalPython" in x or "InArrow" in x]
        assert len(steps) <= 1, (name, steps)


def test_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    empty(spark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
