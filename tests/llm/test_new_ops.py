"""Operators 11 to 13: the whole results by brute force, the libraries and SQL; odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from oracle import connect, rows
from quarrykit.llm import divergence, negatives, registry
from quarrykit.llm.bpe import vocabulary_path
from quarrykit.llm.sentencepiece import MODEL_FILE, Pieces, encode_pieces

# 11


def brute_mine(vectors):
    """vectors: {id: (label, whole numbers)}"""
    out = set()
    for a in (i for i in vectors if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(vectors[a][1], v[1])) for i, v in vectors.items()}
        order = sorted((i for i in vectors if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if vectors[i][0] == vectors[a][0]][:5]:
            window = [i for i in order if vectors[i][0] != vectors[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(window[:10], 1)}
    return out


@pytest.mark.parametrize("parts, block", [(1, 256), (3, 16)])
def test_negatives(spark, monkeypatch, parts, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", -(-8 // parts))
    rng = np.random.default_rng(parts)
    data = [(int(i), int(i) % 3, [int(x) for x in rng.integers(-4, 9, 6)]) for i in rng.permutation(800)]
    df = spark.createDataFrame(data, "vec_id long, label long, vector array<long>").repartition(4)
    got = {tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    want = brute_mine({i: (label, v) for i, label, v in data})
    assert len(want) > 100
    assert got == want


def test_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, 1 if i < 104 else 2, [0.5 - i / 4096, 0.25, 0.125]) for i in range(100, 108)]
    odd = [(None, 1, [0.5] * 3), (1, None, [0.5] * 3), (2, 1, None), (3, 1, [0.5, None, 0.5]), (4, 1, [nan, 0.5, 0.5]), (5, 1, [inf, 0.5, 0.5]), (6, 1, [0.5]), (8, 1, []), good[0], good[7]]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + odd], "vec_id long, label int, embedding array<float>, window string, block int")
    kept = negatives.clean(df)
    assert sorted(r["vec_id"] for r in kept.collect()) == [*range(100, 108)]
    got = {tuple(r) for r in negatives.mine(kept, F.col("vec_id") % 100 == 0, window=(30, 100)).collect()}
    assert {(r[0], r[1]) for r in got} <= {(100, p) for p in (101, 102, 103)} and got
    assert negatives.mine(negatives.clean(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_hilbert_steps():
    """The curve visits every cell once, and next ones are neighbours."""
    cells = np.stack([x.ravel() for x in np.indices((8, 8, 8))], axis=1)
    place = negatives.hilbert(cells, 3)
    assert sorted(place.tolist()) == [*range(512)]
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.integers(-50, 50, (40, 7))
    a = negatives.Anchors(np.arange(9), np.zeros(9), rng.integers(-50, 50, (9, 7)))
    least, most = a.zone(v.min(axis=0), v.max(axis=0))
    scores = negatives.product(a.vectors, v.T)
    assert (least[:, None] <= scores).all() and (scores <= most[:, None]).all()
    big = np.full((1, 2), 1 << 28)
    assert negatives.product(big, big[0])[0] == 2 << 56
    with pytest.raises(OverflowError):
        negatives.product(big * 16, big[0] * 16)


# 12


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL_FILE))


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pieces(spark, sf, library):
    got = {r["doc_id"]: r for r in registry.QUERIES["op12_sentencepiece"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), digest(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_of_odd_texts(library):
    own, r = Pieces(vocabulary_path(MODEL_FILE)), random.Random(3)
    parts = ["a", "b", "ab", "the", " ", "  ", " " * 20, "\t", "\n", "▁", "é", "中", "文字", "🙂", "̀", "�", "0", "<s>", "</s>", "<0x41>", "ing", "\x00", "ß", "אב", "=-", "aaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += [c * n + end for c in (" ", "a", "=-") for n in range(70) for end in ("", "the")]
    texts += [" " * 20_000, "ab" * 10_000, "中文" * 10_000, "".join(r.choice("ACGT") for _ in range(10_000)), "".join(r.choice("abcdefghij") for _ in range(5_000))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert own.decode(ids) == library.decode(want)
    for _ in range(2000):
        some = [r.randrange(600) for _ in range(r.randrange(12))]
        assert own.decode(np.array(some, "<u4").tobytes()) == library.decode(some)


def test_pieces_odd_rows(spark, odd, nothing):
    got = encode_pieces(odd, vocabulary_path(MODEL_FILE), keep_ids=True).collect()
    assert got and len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == 2 and by_id[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[4]["ids_sha256"] == by_id[5]["ids_sha256"] and None in by_id
    assert encode_pieces(nothing, vocabulary_path(MODEL_FILE)).count() == 0


# 13


def brute_divergence(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    per, seen = {}, {}
    for _, text, lang, source in docs:
        words = [w.translate(lower) for w in term.findall(text or "")]
        per.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(set(words))
    out = []
    for lang, groups in per.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        v, all_ = len(kept), sum(groups.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in groups.items()}, shares(all_)
        for s in groups:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(apart(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("tile", [256, 2])
def test_divergence(spark, documents, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", 50)
    r = random.Random(tile)
    words = "Alpha beta-Gamma ÉTÉ été naïve x1y z 中文 — delta's eta theta".split(" ")
    data = [(i, r.choice([None, "", "1 2", *[" ".join(r.choice(words[: 3 + i % 9]) for _ in range(r.randrange(30))) for _ in range(6)]]), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "ä", None])) for i in range(160)]
    data += [(900, "only here", "xx", "a"), (901, None, "xx", "b"), (902, "", "yy", None)]
    assert as_rows(divergence.divergence(documents(data))) == brute_divergence(data, 10, 10)


def test_divergence_odd(odd, nothing):
    got = divergence.divergence(odd, least=1).collect()
    assert {(r["lang"], r["source"]) for r in got} >= {("en", "a"), ("en", "b"), ("en", "")}
    assert all(r["value"] >= 0 and r["rank"] >= 1 for r in got)
    assert divergence.divergence(nothing).count() == 0


def test_translate():
    text = "".join(map(chr, range(256))) * 2 + "Zz"
    assert divergence.text_counts(text) == Counter(w.lower().encode() if w.isascii() else w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_divergence"])
def test_sql_has_rows(spark, sf, name):
    got = rows(registry.QUERIES[name](spark, sf).toPandas())
    assert got and got == rows(connect(sf).execute(registry.ORACLES[name]).fetchdf())
