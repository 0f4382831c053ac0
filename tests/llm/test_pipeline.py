import re

import pytest

import corpus_pipeline
from quarrykit.llm import common, components, ngram_join, ngrams

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, size = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf))
        size[name] = docs.count()
        if name != "tokens":
            assert docs.columns == COLUMNS
            assert docs.join(before, COLUMNS, "left_anti").count() == 0
        before = docs
    assert size["language"] >= size["quality"] >= size["near_duplicates"] > 0 and size["mixture"] == size["tokens"]
    assert size["language"] >= 0.98 * spark.read.parquet(f"{sf}/documents.parquet").count()


def test_near_duplicates_keep_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    groups = ngram_join.link(docs, 5, 80)
    assert kept.count() == groups.select("component_id").distinct().count()
    sets = [set(zip(*(w[i:] for i in range(5)))) for w in (re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower()) for r in kept.collect()) if len(w) >= 5]
    assert not any(10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :])


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_stages_take_anything(spark, sf, request, which):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf))
        assert name == "tokens" or set(COLUMNS) <= set(docs.columns)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_duplicates_keep_what_is_not_linked(spark, documents):
    """Documents without an id, and two texts of one id, are told apart by their components."""
    text = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    rows = [(None, text("a"), "en", "s"), (None, text("b"), "en", "s"), (None, text("b"), "en", "s"), (1, text("c"), "en", "s"), (1, text("d"), "en", "s"), (2, text("d"), "en", "s"), (None, text("c"), "en", "s")]
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept) == [("1", "c"), ("1", "d"), ("None", "a"), ("None", "b")]


def test_near_duplicates_run_one_python_step_in_a_stage(spark, sf, monkeypatch):
    """Two in one stage take two workers for each task, and each worker keeps memory until the session ends."""
    plans = []

    def seen(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, *by)

    for module in (components, ngram_join):
        monkeypatch.setattr(module, "materialize", seen)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plans.append(corpus_pipeline.near_duplicates(spark, docs, sf)._jdf.queryExecution().executedPlan().toString())
    steps = [re.findall(r"Exchange|InArrow", plan) for plan in plans]
    assert any("InArrow" in s for s in steps)
    assert not any(a == b == "InArrow" for s in steps for a, b in zip(s, s[1:]))


def test_workers_let_go_of_tables():
    """What hashing words holds, 32 MB for a block of texts, goes when a task ends."""
    texts = [b"some words of a text " * 50_000]
    (out,) = common.lean(lambda batches: (len(ngrams.word_hashes(texts)[0]) for _ in batches))([0])
    assert out == 250_000 and not ngrams._held
    common.lean_group(lambda group: ngrams.word_hashes(texts))(None)
    assert not ngrams._held
