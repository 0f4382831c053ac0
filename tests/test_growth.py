"""What must not grow faster than the input: work done once for each row, and what one task or one batch holds."""

from quarrykit.functions.sentences import Meter, estimate, sentences
from quarrykit.operators import chunking, evidence, salvage
from quarrykit.operators.groups import dealt
from quarrykit.plans import evolution, retrieval

def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()

def test_items_are_parsed_once(spark):
    item = '{"kind": " Tool ", "title": "t", "body": "b", "confidence": "0.25", "aliases": [" x ", ""]}'
    texts = [item.join(['{"cards": [', "]}"]), f'```json\n{{"cards": [{item}]}}\n```', f'Cards: {{"cards": [{item}]}} [that] is all', f'{{"cards": [{item}, {{"kind": "to', f"[{item}]", "none", "", None, "true", '{"cards": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    as_json, as_variants = (salvage.cards(salvage.items(df, ["id"], "text", ["cards", "items"], json=j), ["id"]) for j in (True, False))
    # the item is parsed where it is JSON, and not again for each field of a card
    assert _plan(as_json).count("parse_json") <= 1
    columns = ["id", "how", "field", "pos", "kind", "title", "body", "aliases", "confidence", "ok"]
    got = [sorted(tuple(r) for r in x.select(columns).collect()) for x in (as_json, as_variants)]
    row = lambda i, how, field: (i, how, field, 0, "tool", "t", "b", ["x"], 0.25, True)
    assert got[0] == got[1] == [row(0, "parsed", "cards"), row(1, "parsed", "cards"), row(2, "parsed", "cards"), row(3, "salvaged", "cards"), row(4, "parsed", "items")]


def test_search_legs_run_once(spark, sf):
    fused, evidence, _, _ = retrieval._chunk_search(spark, sf)
    # legs and chunks are read, not made again for each use
    assert "MapInArrow" not in _plan(fused) and "MapInArrow" not in _plan(evidence)


def test_sentences_and_meters():
    text = "a.b c. d!」 e。」\n\nf? g.h"
    assert sentences(text) == ["a.b c.", " d!」 e。」\n\n", "f?", " g.h"]
    assert sentences("") == [] and sentences("a. ") == ["a.", " "]
    assert Meter("plain").wide is None  # no sums over characters where none is wide
    assert [Meter(t).tokens(0, len(t)) for t in ("plain", "中文 and", "é" * 5)] == [2, 3, 2]


def test_parts_grow_in_number(spark, sf):
    assert dealt(spark.range(1001), ["id"], rows=100).rdd.getNumPartitions() == 11
    assert dealt(spark.range(0), ["id"]).rdd.getNumPartitions() == 1
    # questions and scores are dealt out by their rows, not by a fixed number of partitions
    for q in (evolution.evolution_runs, evolution.evolution_insights):
        assert "RepartitionByExpression" in _plan(q(spark, sf))


def test_pages_leave_in_small_batches(spark):
    texts = ["a\nb"] * 600 + ["x" * chunking.PAGE_CHARS] * 3 + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    out = chunking.page_rows(df, "id", "text", "\n")
    assert "PythonUDTF" not in _plan(out)  # which holds the pages of a whole batch of texts
    assert out.count() == 1203
    assert [tuple(r) for r in out.filter("id IN (0, 600)").selectExpr("id", "page", "char_start", "char_end", "length(content)").orderBy("id", "page").collect()] == [(0, 1, 0, 1, 1), (0, 2, 1, 2, 1), (600, 1, 0, chunking.PAGE_CHARS, chunking.PAGE_CHARS)]


def test_compaction_reads_only_parts_that_may_hold_a_term(monkeypatch):
    filler = [f"Nothing of note happens in sentence number {i} of this long text, which only fills the page." for i in range(60)]
    text = " ".join([*filler[:30], "The QUOKKA naps, as quokkas do.", *filler[30:]])
    read, whole = [], evidence.question_terms
    monkeypatch.setattr(evidence, "question_terms", lambda t: read.append(t) or whole(t))
    out = evidence.compacted(text, "Where does a quokka nap?")
    assert "The QUOKKA naps" in out and len(out) < len(text) and out.startswith(filler[0])
    assert len(read) <= 2  # the question and one sentence; before, all 61
    assert evidence.compacted(text, "Where is a wombat?") == text


def test_estimate_of_wide_text():
    assert [estimate(t) for t in ("", "abcde", "中文ab", "é" * 5, "\U00020000a")] == [0, 2, 3, 2, 1]
