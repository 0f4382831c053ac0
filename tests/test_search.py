"""Sibling merge rule by rule, BM25 by brute force on both ways, and a whole search against plain steps."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import retrieval, search

COLUMNS = "query_id long, pos int, id long, kind string, doc string, heading string, ordinal int, start long, end long, content string, score double"


def chunk(pos, ordinal, start, text, score=0.5, kind="body", heading="h", end=None, id_=None):
    return (1, pos, 10 + ordinal if id_ is None else id_, kind, "d", heading, ordinal, start, start + len(text) if end is None else end, text, score)


@pytest.mark.parametrize(
    "rows, least, want",
    [
        ([chunk(2, 0, 0, "aa", 0.1), chunk(1, 1, 2, "bb", 0.9), chunk(3, 2, 4, "cc", 0.9)], 2, [(1, 11, 0, 0, 6, "aabbcc", [10, 11, 12])]),
        ([chunk(1, 0, 0, "aa"), chunk(2, 1, 3, "bb")], 2, [(1, 10, 0, 0, 2, "aa", []), (2, 11, 1, 3, 5, "bb", [])]),  # a gap
        ([chunk(1, 0, 0, "aa"), chunk(2, 1, 2, "bb", kind="summary")], 2, [(1, 10, 0, 0, 2, "aa", []), (2, 11, 1, 2, 4, "bb", [])]),
        ([chunk(1, 0, 0, "aa"), chunk(2, 1, 2, "|h|bb", end=4)], 2, [(1, 10, 0, 0, 2, "aa", []), (2, 11, 1, 2, 4, "|h|bb", [])]),  # a copied header
        ([chunk(1, 0, 0, "aa"), chunk(2, 1, 2, "bb", heading="other")], 2, [(1, 10, 0, 0, 2, "aa", []), (2, 11, 1, 2, 4, "bb", [])]),
        ([chunk(1, 0, 0, "aa", heading=None), chunk(2, 1, 2, "bb", heading="")], 2, [(1, 10, 0, 0, 4, "aabb", [10, 11])]),
        ([chunk(1, 0, 0, "aa"), chunk(2, 1, 2, "bb")], 3, [(1, 10, 0, 0, 2, "aa", []), (2, 11, 1, 2, 4, "bb", [])]),
        ([chunk(3, 0, 0, "aa"), chunk(1, 1, 2, "bb"), chunk(2, 3, 9, "dd"), chunk(4, 4, 11, "ee")], 2, [(1, 10, 0, 0, 4, "aabb", [10, 11]), (2, 13, 3, 9, 13, "ddee", [13, 14])]),
    ],
)
def test_siblings(spark, rows, least, want):
    got = retrieval.sibling_merge(spark.createDataFrame(rows, COLUMNS), least).orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["ordinal"], r["start"], r["end"], r["content"], r["merged"]) for r in got] == want


@pytest.mark.parametrize("literal", [10_000, 0])
def test_bm25(spark, monkeypatch, literal):
    monkeypatch.setattr(retrieval, "LITERAL_TERMS", literal)
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choice(words[: 5 + i % 26]) for _ in range(r.randrange(40)))) for i in range(120)] + [(200, None), (201, "")]
    queries = [(q, " ".join(r.choices(words, k=r.randint(1, 6)))) for q in range(12)] + [(90, "none of these"), (91, "")]
    got = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in retrieval.bm25(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(queries, "query_id long, query string"), 7).collect()}
    tokens = {i: re.findall("[0-9a-z]+", t) for i, t in docs if t is not None}
    known = [len(t) for t in tokens.values()]
    n, avgdl = len(docs), sum(known) / len(known) if literal else sum(known) / len(known)
    want = {}
    for q, text in queries:
        scores = {}
        for t in set(re.findall("[0-9a-z]+", text)):
            df = sum(t in d for d in tokens.values())
            for i, d in tokens.items():
                if tf := d.count(t):
                    scores[i] = scores.get(i, 0.0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avgdl))
        for k, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:7], 1):
            want[q, k] = (i, pytest.approx(scores[i], abs=2e-6))
    assert len(want) > 50 and got == want


def plain_search(rows, scores, limit):
    """rows best first; (id, text, doc, ordinal, start)"""
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    alike = lambda a, b: len(grams(a) & grams(b)) / min(len(grams(a)), len(grams(b)))

    def suppress(x):
        kept = []
        for row in x:
            if not any(alike(row[1], k[1]) > 0.85 for k in kept):
                kept.append(row)
        return kept

    rows = suppress(rows[:50])
    if any(scores.get(r[0]) is not None for r in rows):
        rows = sorted((r for r in rows if scores.get(r[0]) is not None), key=lambda r: -scores[r[0]])
    rows = suppress(rows[: 2 * limit])
    raw = [1 / (k + 2) for k in range(len(rows))]
    rel = {r[0]: (x - raw[-1]) / (raw[0] - raw[-1]) if len(raw) > 1 else 1.0 for r, x in zip(rows, raw)}
    picked = []
    while rows:
        best = max(rows, key=lambda r: 0.7 * rel[r[0]] - 0.3 * max([alike(r[1], p[1]) for p in picked], default=0.0))
        picked.append(best)
        rows.remove(best)
    out, used = [], set()
    for r in picked:
        if r[0] in used:
            continue
        run = [r]
        for step in (1, -1):
            at = r
            while nxt := next((x for x in picked if x[2] == at[2] and x[3] == at[3] + step and (x[4] == at[4] + len(at[1]) if step > 0 else at[4] == x[4] + len(x[1]))), None):
                run.append(nxt)
                at = nxt
        used |= {x[0] for x in run}
        out.append("".join(x[1] for x in sorted(run, key=lambda x: x[3])))
    return out[:limit]


def test_whole_search(spark):
    r = random.Random(2)
    text = lambda: "".join(r.choice("abcdefghij ") for _ in range(60))
    chunks, id_ = [], 0
    for d in range(12):
        at = 0
        for o in range(3):
            t = chunks[-4][1][:-2] + "zz" if d % 4 == 3 and o == 0 else text()
            chunks.append((id_, t, f"d{d}", o, at))
            at += len(t) + (5 if r.random() < 0.3 else 0)
            id_ += 1
    evidence = spark.createDataFrame([(i, "body", d, None, o, s, s + len(t), t) for i, t, d, o, s in chunks], "id long, kind string, doc string, heading string, ordinal int, start long, end long, content string")
    legs, order = {"a": [], "b": []}, {}
    for q in range(4):
        for leg in legs:
            ids = r.sample(range(id_), 20 if (q, leg) != (1, "b") else 0)
            legs[leg] += [(q, k, i) for k, i in enumerate(ids, 1)]
            for k, i in enumerate(ids, 1):
                old = order.setdefault(q, {}).get(i, (0.0, (9, 9)))
                order[q][i] = (old[0] + 1 / (60 + k), min(old[1], (list(legs).index(leg), k)))
    hits = search.fused([(n, spark.createDataFrame(x, "query_id long, rank int, id long")) for n, x in legs.items()])
    score = F.when(F.col("query_id") >= 2, F.when(F.col("id") % 3 > 0, (F.col("id") * 37 % 101) / 101.0))
    got = search.retrieve(hits, evidence, lambda c: c.withColumn("rerank", score), limit=6).collect()
    for q in range(4):
        ids = sorted(order[q], key=lambda i: (-round(order[q][i][0], 9), order[q][i][1], i))
        scores = {i: i * 37 % 101 / 101 if i % 3 else None for i in range(id_)} if q >= 2 else {}
        own = sorted((x for x in got if x["query_id"] == q), key=lambda x: x["pos"])
        assert [x["content"] for x in own] == plain_search([chunks[i] for i in ids], scores, 6)
        assert {x["reranked"] for x in own} == {q >= 2} and all(x["legs"] and set(x["legs"]) <= set(legs) for x in own)
    flags = {x["query_id"]: tuple(x)[1:] for x in search.degraded(spark.range(5).select(F.col("id").alias("query_id")), hits, ["a", "b"], search.retrieve(hits, evidence, lambda c: c.withColumn("rerank", score), limit=6)).collect()}
    assert flags == {0: (False, False, True), 1: (False, True, True), 2: (False, False, False), 3: (False, False, False), 4: (True, True, True)}


def test_asked_words_are_latin_terms_without_lambdas_over_words(spark):
    """Words are cut by Arrow, inside the row, and are those that the expression gives, for null and empty texts too."""
    from quarrykit.functions.text import latin_terms

    texts = ["", None, " The İstanbul the, x9", "a", "--", "naïve Kelvin K9 the"] * 60
    names = ["9", "a", "i", "stanbul", "the", "x9"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    got = df.select("id", F.lower("x").alias("x")).mapInArrow(retrieval._asked_words(names, "id"), "id long, dl int, t array<int>").collect()
    want = {r["id"]: r["w"] for r in df.select("id", latin_terms(F.col("x")).alias("w")).collect()}
    assert len(got) == len(texts)
    for r in got:
        w = want[r["id"]]
        assert r["dl"] == (None if w is None else len(w)) and [names[i] for i in r["t"]] == [x for x in w or [] if x in names]
