"""Chunks: what must hold of every cut, a stored result, pages; names in texts against plain search."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.functions.sentences import WIDE_CHUNK, Meter, estimate, pages, sentences
from quarrykit.operators import chunking, graph

LINES = ["Plain words stand here. ", "More? Yes!", "“Quoted.” Then", "一句话。另一句；", "", " ", "```", "~~~", "| a | b |", "| --- | :-: |", "| 1 | 2 |", "|x", "# Top", "## Sub #", "#no", "word " * 30, "x" * 90, "\tindented", "3.14 is no end"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=40), st.integers(1, 80), st.integers(-3, 60))
def test_cuts(lines, target, overlap):
    text = "\n".join(lines)
    body, _ = pages(text, chunking.PAGE_MARK)
    cutter = chunking.Cutter(body, target, overlap)
    rows = chunking.chunk_rows(text, target, overlap)
    covered = set()
    for n, (ordinal, content, start, end, _, _, tokens) in enumerate(rows):
        assert ordinal == n and content.endswith(body[start:end]) and content.strip()
        header = content[: len(content) - (end - start)]
        assert not header or (header.lstrip().startswith("|") and header in body[:start])
        assert tokens == estimate(content, WIDE_CHUNK)
        # only what can't be divided is over the target: one character, or a header and a row
        assert tokens <= cutter.target or end - start == 1 or body[start:].startswith("|")
        covered |= set(range(start, end))
    assert all(i in covered or body[i].isspace() for i in range(len(body)))
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)


def slow_reach(text, start, end, budget):
    return max([k for k in range(start, end + 1) if k == start or estimate(text[start:k], WIDE_CHUNK) <= budget], default=start)


@given(st.text("ab一二 \n", max_size=60), st.integers(0, 30), st.data())
def test_meter(text, budget, data):
    m = Meter(text)
    a = data.draw(st.integers(0, len(text)))
    assert m.tokens(a, len(text)) == estimate(text[a:], WIDE_CHUNK)
    assert m.reach(a, len(text), budget) == slow_reach(text, a, len(text), budget)


@pytest.mark.parametrize(
    "text, want",
    [
        ("12.5 nM. Next", ["12.5 nM.", " Next"]),
        ("完成。」\n下一句；x", ["完成。」\n", "下一句；", "x"]),
        ('He said "stop." Then? No.', ['He said "stop." Then?', " No."]),
        ("a\n\nb", ["a\n\n", "b"]),
        ("", []),
    ],
)
def test_sentence_rule(text, want):
    assert sentences(text) == want


def test_long_table_keeps_its_header():
    head = "| h | k |\n| --- | --- |\n"
    text = "# A\n\nIntro.\n\n" + head + "".join(f"| row {i} | {'v' * 20} |\n" for i in range(40))
    rows = chunking.chunk_rows(text, 60, 10)
    assert all(r[1].startswith(head) for r in rows[1:]) and len(rows) > 5
    assert [r[1].count("| row ") for r in rows].count(0) == 0 and sum(r[1].count("| row ") for r in rows) == 40
    long = "| " + "h" * 200 + " |\n| --- |\n" + "".join(f"| row {i} |\n" for i in range(60))
    assert not any(r[1].startswith("| hhh") for r in chunking.chunk_rows(long, 60, 0)[1:])


def test_stored_result():
    text = "# T\n\nOne two three. Four five six. Seven eight.\n\n```\n| x |\n\n# no\n```\n\nLast words here to end it.\n"
    got = [(r[2], r[3], r[4], r[6]) for r in chunking.chunk_rows(text, 12, 4)]
    # 12 tokens in the first chunk; then 8 and an overlap of whole sentences of 4: ' Seven eight.', then '# no' and the end of the fence
    assert got == [(0, 47, "T", 12), (34, 68, "T", 9), (60, 96, "T", 9)]


def test_pages(spark):
    m = chunking.PAGE_MARK
    text = f"  \r\nfirst{m}{m}second\r\npage{m}  \n"
    body, spans = pages(text, m)
    assert body == "firstsecond\npage" and [(p, body[a:b]) for p, a, b in spans] == [(1, "first"), (3, "second\npage")]
    df = spark.createDataFrame([(1, text), (2, None), (3, m)], "id long, text string")
    assert [tuple(r) for r in chunking.page_rows(df, "id", "text").orderBy("page").collect()] == [(1, 1, 0, 5, "first"), (1, 3, 5, 16, "second\npage")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, " \n "), (None, "words"), (3, "x" * 100_000), (3, "x" * 100_000)], "id long, text string")
    got = chunking.chunk_documents(df, "id", "text").collect()
    assert {r["id"] for r in got} == {None, 3}
    assert sum(r["char_end"] - r["char_start"] for r in got if r["id"] == 3) == 200_000
    assert chunking.chunk_documents(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("chars", [4_000_000, 5])
def test_names(spark, monkeypatch, chars):
    monkeypatch.setattr(graph, "NAME_CHARS", chars)
    r = random.Random(chars)
    names = ["a", "ab", "abc", "bca", "cab", "zz", "中", "", None, "ab"]
    texts = [(i, "".join(r.choice("abcx中 ") for _ in range(r.randrange(20)))) for i in range(60)] + [(100, None), (101, "")]
    df = graph.mentions(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(n,) for n in names], "name string"), "id", "t", 3)
    want = set()
    for i, t in texts:
        own = sorted({n for n in names if n and n in (t or "")}, key=lambda n: (-len(n), n))[:3]
        want |= {(i, n, k) for k, n in enumerate(own, 1)}
    assert {tuple(x) for x in df.collect()} == want


def test_no_names(spark):
    assert graph.mentions(spark.createDataFrame([(1, "abc")], "id long, t string"), spark.createDataFrame([("",)], "name string"), "id", "t").count() == 0
