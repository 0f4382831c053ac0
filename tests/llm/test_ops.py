import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import connect, rows
from quarrykit.llm import components as components_module
from quarrykit.llm import attention, bpe, common, extract, fingerprint, langid, lm, mixing, ngram_join, ngrams, quality, registry, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == [*range(1, 14)]
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).execute(registry.ORACLES[name]).fetchdf())


# 1


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        share, left = left, 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s] / w
        for s in [*open_]:
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix(spark, docs):
    got = mixing.mix(spark.createDataFrame(docs)).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert len(got) == len(docs)
    assert [len(WORD.findall(t)) for t in got["text"]] == got["size"].tolist()
    want = brute_targets(got.groupby("source")["size"].sum().to_dict())
    for s, g in got.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(want[s], rel=1e-9)
        assert g["taken"].sum() == pytest.approx(want[s], rel=0.03)  # a source has ten documents here
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(spark.createDataFrame(docs.sample(frac=1, random_state=1)).repartition(5)).toPandas()
    assert got.set_index("doc_id")["taken"].to_dict() == again.set_index("doc_id")["taken"].to_dict()


def test_mix_caps(spark, documents):
    rng = random.Random(1)
    rows_ = [(i, "w " * rng.randint(1, 60), "en", ["a", "b", None, "d"][min(i % 40, 3)]) for i in range(400)]
    got = mixing.mix(documents(rows_)).toPandas()
    sizes = collections.Counter()
    for _, t, _, s in rows_:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    assert max(want[s] / sizes[s] for s in sizes) == pytest.approx(3)
    for name, g in got.groupby("s"):
        assert g["target"].iloc[0] == pytest.approx(want[None if name == "0" else name[1:]], rel=1e-9)
        assert g["taken"].sum() == pytest.approx(g["target"].iloc[0], rel=0.03)


def test_mix_ties(documents):
    """Sizes that tie in rounding: one document more or less is all that a source can be off."""
    got = mixing.mix(documents([(i, "w " * 7, "en", "ab"[i % 2]) for i in range(101)])).toPandas()
    for _, g in got.groupby("s"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 7


def test_mix_odd(odd, nothing):
    assert mixing.mix(odd).count() == 9 and mixing.mix(nothing).count() == 0
    assert set(mixing.mixed(odd).columns) == set(odd.columns)


# 2


def test_lm(spark, docs):
    got = lm.score(spark.createDataFrame(docs), lm.vocabulary_path(lm.ENCODE_FILE)).toPandas().merge(docs[["doc_id", "text"]], on="doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs["doc_id"]}
    counts = collections.Counter()
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        if not held[i]:
            counts.update([*WORD.findall(t.translate(LOWER)), None])
    n, v = sum(counts.values()), len(counts)
    for r in got.itertuples():
        words = [*WORD.findall(r.text.translate(LOWER)), None]
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(words) and r.train_tokens == n
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    assert (got["score"] < 0).all() and np.isfinite(got["score"]).all()
    shuffled = got["text"].map(lambda t: -2.0 * len(t))
    assert (got["score"] > shuffled).mean() > 0.95


def test_lm_odd(odd, nothing):
    path = lm.vocabulary_path(lm.ENCODE_FILE)
    got = lm.score(odd, path).toPandas()
    assert len(got) == 9 and got["n_tokens"].min() == 1 and np.isfinite(got["score"]).all()
    twice = got[got["doc_id"] == 5]
    assert len(twice) == 2 and twice["n_known"].nunique() == 1 and twice["base_score"].nunique() == 1
    assert lm.score(nothing, path).count() == 0


def test_attention_windows_score_each_token_once():
    for n in (1, 2, 31, 32, 33, 55, 56, 57, 500):
        ids = np.arange(n + 1)
        _, targets, first, last = attention.windows(ids)
        place = np.arange(attention.WINDOW)
        assert targets[(place >= first[:, None]) & (place < last[:, None])].tolist() == [*range(1, n + 1)]


def test_attention_is_causal_and_its_gradient_right():
    rng = np.random.default_rng(0)
    p = {k: v + 0.1 * rng.standard_normal(v.shape).astype(np.float32) for k, v in attention.start(9).items()}
    ids = rng.integers(0, 9, (2, 12))
    changed = ids.copy()
    changed[:, 7:] = 0
    assert np.allclose(attention.hidden(p, ids)[0][:, :7], attention.hidden(p, changed)[0][:, :7], atol=1e-5)
    targets, weight = rng.integers(0, 9, (2, 12)), np.ones((2, 12), np.float32)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    _, g = attention.step(p, ids, targets, weight)
    for name, x in p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), x.shape)
        old, e = x[at], 1e-5
        x[at] = old + e
        up = attention.step(p, ids, targets, weight)[0]
        x[at] = old - e
        down = attention.step(p, ids, targets, weight)[0]
        x[at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[name][at], rel=2e-2, abs=1e-5)


def test_model_classes_sum_to_one():
    p = attention.start(9)
    ids = np.zeros((1, 5), int)
    total = sum(np.exp(attention.log_probabilities(p, ids, np.full((1, 5), t), np.ones((1, 5), bool))) for t in range(9))
    assert np.allclose(total, 1, atol=1e-5)


# 3


def shingles(text, size=5, lower=str.lower):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark, docs):
    got = fingerprint.fingerprints(spark.createDataFrame(docs)).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    errors = []
    for i, r in order.iterrows():
        after = order["text"][(i + 1) % len(order)]
        n = len(r["text"])
        edited = r["text"][: n - n // 3] + after[: n // 3]
        own = got.loc[r["doc_id"]]
        assert own["n_chars"] == n and own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(own["near_edited"] - jaccard(shingles(r["text"]), shingles(edited)))
        errors.append(own["near_next"] - jaccard(shingles(r["text"]), shingles(after)))
    assert max(map(abs, errors)) < 0.15 and np.sqrt(np.mean(np.square(errors))) < 0.03
    same = docs.assign(f=docs["doc_id"].map(got["fingerprint"])).groupby("text")["f"].nunique()
    assert same.max() == 1


def test_fingerprints_in_ranges(spark, docs, monkeypatch):
    whole = fingerprint.fingerprints(spark.createDataFrame(docs)).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 9)
    parts = fingerprint.fingerprints(spark.createDataFrame(docs)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert whole.equals(parts)


def test_fingerprint_merge(spark):
    a, b = ("one two three four five six seven eight nine ten " * 1), "six seven eight nine ten eleven twelve thirteen fourteen"
    df = fingerprint.with_sketch(spark.createDataFrame([("k", a), ("k", b)], "k string, t string"), "t", "s", 4)
    merged = fingerprint.merge_sketches(df, ["k"], "s", 4).first()["s"]
    assert merged == sorted({x for r in df.collect() for x in r["s"]})[:4]


def test_fingerprint_odd(odd, nothing):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == 9 and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {""}
    assert fingerprint.fingerprints(nothing).count() == 0


# 4


def test_langid(spark, docs):
    got = langid.identify(spark.createDataFrame(docs)).toPandas().merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    held = got[got["held_out"] & (got["text"].str.len() > 100)]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and got["rejected"].mean() < 0.02


def test_langid_odd(spark, odd, nothing):
    got = langid.identify(odd).toPandas()
    assert len(got) == 9 and set(got[got["doc_id"].isin([1, 2, 3, 8])]["lang_pred"]) == {"und"}
    assert langid.identify(nothing).count() == 0 and langid.keep_known(nothing).columns == nothing.columns
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    t = ["hello world über " * 50, "", "12 !", "a", "日本語"]
    whole = langid.vectors(t)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.array_equal(whole, langid.vectors(t))


# 5


def components(sets, percent):
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in sets}


def near_copies(seed=5, n=240):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 12, 40, 150, 400]))]
        for _ in range(n // 12):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t) + (" " + passage if g % 3 == 0 and rng.random() < 0.5 else ""))
    rng.shuffle(out)
    return [(i, t.upper() if i % 7 == 0 else t, "en", "s") for i, t in enumerate(out)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_finds_every_link(documents, monkeypatch, size, percent):
    rows_ = near_copies()
    want = components({i: shingles(t, size) for i, t, _, _ in rows_}, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(documents(rows_), size, percent).collect()}
    assert {i: c for i, (_, c) in got.items()} == want and all(got[i][0] == len(shingles(t, size)) for i, t, _, _ in rows_)
    if size == 5:
        return
    # the same with blocks and tiles cut into many parts, and with most shingles late in the order
    for name, value in (("HEAVY", 3), ("BLOCK_CLASSES", 7), ("FEW", 2), ("TILE_SHINGLES", 1500), ("TILE_POINTS", 400), ("TILE_CLASSES", 11), ("FANOUT", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(documents(rows_), size, percent).collect()}
    assert got == want


def test_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, len(a))], rng.integers(0, 400, 50).astype(np.uint64)]))
        a, b = (np.unique(ngrams.mix(x)) for x in (a, b))
        bound = np.minimum(ngram_join.counts_of(a), ngram_join.counts_of(b)).sum()
        assert bound >= len(np.intersect1d(a, b))


def test_join_odd(odd, nothing):
    got = ngram_join.link(odd).toPandas()
    assert len(got) == 9 and set(got[got["doc_id"].isin([4, 5])]["component_id"]) == {4}
    assert got[got["doc_id"].isin([1, 2, 3])]["component_id"].tolist() == got[got["doc_id"].isin([1, 2, 3])]["doc_id"].tolist()
    kept = ngram_join.keep_first(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8"]) and kept.columns == odd.columns
    assert ngram_join.link(nothing).count() == 0 and ngram_join.keep_first(nothing).count() == 0


# 6 and 8


def strange_texts():
    rng = random.Random(3)
    letters = [chr(c) for c in (9, 10, 11, 12, 13, 28, 32, 32, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0xFEFF)] + list("abcdEFG'stll've0123,.!<|>") + ["é", "ß", "中", "文", "अ", "😀", "²", "Ⅷ", "̈", "<|endoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * 5000, "ab" * 3000, " " * 900 + "x", "".join(rng.choice("etaoin") for _ in range(6000)), ""]


def test_encoder_is_the_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.Encoder(bpe.vocabulary_path(bpe.ENCODE_FILE))
    want = tiktoken.Encoding("own", pat_str=bpe.piece_pattern(), mergeable_ranks=e.ranks, special_tokens={})
    for t in [*docs["text"], *strange_texts()]:
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t) and e.decode(ids) == t.encode()


def test_counter_is_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path(bpe.COUNT_FILE)
    c, want = bpe.Counter(path), tokenizers.Tokenizer.from_file(path)
    for t in [*docs["text"], *strange_texts()]:
        assert c.count(t) == len(want.encode(t, add_special_tokens=False).ids)


def test_bpe_odd(odd, nothing):
    got = bpe.encode_texts(odd, bpe.vocabulary_path(bpe.ENCODE_FILE), keep_ids=True).toPandas()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 9 and set(got[got["doc_id"].isin([1, 2])]["ids_sha256"]) == {empty}
    counted = bpe.count_tokens(odd, bpe.vocabulary_path(bpe.COUNT_FILE)).toPandas()
    assert counted["n_bytes"].min() == 0 and counted["over_limit"].sum() == 3
    assert bpe.count_tokens(nothing, bpe.vocabulary_path(bpe.COUNT_FILE)).count() == 0 and bpe.encode_texts(nothing, bpe.vocabulary_path(bpe.ENCODE_FILE)).count() == 0


# 7

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:"</p>"}</style><script>var t="</p>";</script></head><body>
<header class="top"><a href="x">Home</a></header><nav><ul><li>Menu</li></ul></nav><div id="cookie-notice"><p>We use cookies for all of it.</p></div>%s
<div class="sidebar"><p>Side text that is long enough to look like some real text.</p></div>%s
<div class="comments"><p>I think that this comment is long enough to be text.</p></div><form><input>Send</form><footer>&copy; foot</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>First\n   paragraph with <b>bold</b> words, and a good deal of text in it.</p><div class='ad-slot'>BUY</div><p>Short.</p><ul><li>one &lt;item&gt;</li></ul>"
TEXT = "Title & more\nFirst paragraph with bold words, and a good deal of text in it.\nShort.\none <item>"


@pytest.mark.parametrize("page", [PAGE % ("<article>" + BODY + "</article>", ""), PAGE % ("<main>" + BODY + "</main>", ""), PAGE % ("", "<div class='content'>" + BODY + "</div>")])
def test_extract(page):
    assert extract.main_text(page) == TEXT


PROSE = "".join(f"<p>Paragraph {i} of the text, which is long enough to count as what the page is about.</p>" for i in range(4))
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>More to read {i}</a></li>" for i in range(5)) + "</ul>"


def test_extract_decides_within_articles_and_without_them():
    want = "\n".join(re.findall("<p>(.*?)</p>", PROSE))
    # links and what stands among them go though no listed class names them; titles stay, even as links
    assert extract.main_text(PAGE % (f"<article><h1><a href='x'>Title</a></h1>{PROSE}<div class='k7'>{LINKS}<p>Follow us</p>{LINKS}</div></article>", "")) == "Title\n" + want
    # a listed class on the body of an article, and an article element that holds a teaser only
    assert extract.main_text(PAGE % (f"<article><h1>Title</h1><div class='notice share'>{PROSE}</div></article>", "")) == "Title\n" + want
    assert want in extract.main_text(f"<body><div>{PROSE}</div><article><p>Teaser.</p></article></body>")


def test_extract_keeps_prose_under_weak_words():
    some = ["The price of a share rose again and so did the price of all others.", "The alert level of the river is the third of five, as in the year before.", "The social history of the town is told in this part of the text at length."]
    body = f"<div class='article-header'><h1>Title</h1></div><p class='alert-level'>{some[1]}</p>{PROSE}<p class='share-price'>{some[0]}</p><p class='share'>Tweet</p>{PROSE}<div class='social-history'><p>{some[2]}</p></div>"
    text = extract.main_text(PAGE % (f"<article>{body}</article>", ""))
    assert all(x in text.split("\n") for x in [*some, "Title"]) and "Tweet" not in text
    assert some[0] in extract.main_text(PAGE % ("", f"<div>{body}</div>"))  # in a region of a page without an article element


def test_extract_by_windows_and_thresholds():
    """Without an article element the windows and thresholds decide what is kept."""
    gap = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<body><p>Lead.</p>{gap}<div>{PROSE}</div>{gap}<p>Some text that follows, and is as long as eighty-six characters are, or a bit longer.</p>{gap}<p>End.</p></body>"
    got = extract.main_text(page)
    assert got.startswith("Paragraph 0") and got.endswith("a bit longer.") and "Link" not in got
    assert extract.main_text(page, share=0.5).endswith("is about.") and extract.main_text(page, share=0.0, surge=0).startswith("Lead.") and extract.main_text(page, window=6) != got


def brute_regions(sizes, window, share, surge):
    """The lines kept, each judged for itself: it lies in a run of windows that hold text, at or after the first window of the run that surges."""
    n = len(sizes)
    block = [sum(sizes[i : i + window]) for i in range(n)]
    kept = set()
    for i in range(n):
        run = [i]
        while run[0] and block[run[0] - 1] and block[i]:
            run.insert(0, run[0] - 1)
        while run[-1] + 1 < n and block[run[-1] + 1] and block[i]:
            run.append(run[-1] + 1)
        starts = [j for j in run if sizes[j] and block[j] >= min(surge, share * max(block))]
        if block[i] and starts and i >= starts[0] and max(block[starts[0] : run[-1] + 1]) >= share * max(block) and any(sizes[i : run[-1] + 1]):
            kept.add(i)
    return kept


def test_extract_regions_by_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        sizes = [rng.choice([0, 0, 0, 5, 20, 60, 200]) for _ in range(rng.randint(0, 25))]
        window, share, surge = rng.choice([1, 2, 3, 4]), rng.choice([0.1, 0.25, 0.6]), rng.choice([10, 86, 150])
        got = {j for a, b in extract.regions_of(sizes, window, share, surge) for j in range(a, b)}
        assert got == brute_regions(sizes, window, share, surge)


def test_extract_pages(spark, sf):
    got = registry.QUERIES["op7_html_text"](spark, sf).toPandas()
    pages = pq.read_table(f"{sf}/pages.parquet").to_pandas().set_index("page_id")["html"]
    assert len(got) == len(pages) and (got["n_chars"] == got["text"].str.len()).all()
    for r in got.itertuples():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        words = re.sub(r"<[^>]+>", " ", article.replace("&amp;", "&")).replace("&quot;", '"').split()
        assert r.text.split() == words or len(r.text.split()) > 0.99 * len(words)


def test_extract_odd(spark):
    some = [(1, None, None), (None, "u", ""), (3, "u", "<p>" + "x " * 200_000), (4, "u", "<div class='ad'>never closed <h1>Title</h1><p>Text that is here."), (4, "u", "<div class='ad'>never closed <h1>Title</h1><p>Text that is here.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in some], "page_id long, url string, html string, text string, n_chars int")
    assert extract.extract(df).count() == 5
    got = {r["page_id"]: r["text"] for r in extract.extract(df).collect()}
    assert got[1] == "" and got[None] == "" and len(got[3].split()) == 200_000 and got[4] == "never closed\nTitle\nText that is here."
    assert extract.extract(df.limit(0)).count() == 0


# 9


def test_quality_removes_shared_lines(documents):
    share = "This line stands in every page of the host and says nothing at all."
    rows_ = [(i, f"{share}\nOnly {' '.join(chr(97 + i % 26) * (2 + i // 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(40))}", "en", "h") for i in range(40)] + [(100 + i, f"{share}\nPage {i}", "en", "h") for i in range(5)] + [(200, f"{share}\nPage", "en", "other")]
    got = {r["doc_id"]: r for r in quality.quality(documents(rows_)).collect()}
    assert all(got[i]["kept"] and got[i]["words_left"] == 41 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(5)) and got[200]["kept"]


def test_quality_gives_texts_without_shared_lines(documents):
    share = "This line stands in every page of the host and says nothing at all."
    own = [" ".join(chr(97 + i % 26) * (2 + i // 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(40)) for i in range(40)]
    rows_ = [(i, f"{share}\n\n{t}\n  {share.upper()} \nLast q{i}" if i % 2 else f"{t}\n\n{share}\n", "en", "h") for i, t in enumerate(own)] + [(100, f"{share}\n{own[0]}\n", "en", "other")]
    got = {r["doc_id"]: r for r in quality.keep_good(documents(rows_)).collect()}
    for i, t in enumerate(own):
        assert got[i]["text"] == (f"\n{t}\nLast q{i}" if i % 2 else f"{t}\n\n") and got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == rows_[-1][1] and len(got) == 41


def test_quality_odd(odd, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality(odd).collect()}
    assert got[1, 0]["base_failed"] and got[4, 20_000]["kept"] and got[None, 10]["kept"]
    assert quality.keep_good(odd).count() == 4 and quality.keep_good(odd).columns == odd.columns
    assert quality.quality(nothing).count() == 0


# 10


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: -7\r\n\r\nA\nfiledesc://x 1 2 3 4\r\n\r\nWARC/1.1\r\nend"
    arc = warc.write_arc("a.arc", version, "20240102030405", [("http://a b/", "1.2.3.4", "text/html; charset=x", body), ("http://c/", "0.0.0.0", "text/html", b"")])
    import io

    records = [*warc.read_warc(io.BytesIO(warc.END.encode().join([*warc.convert_arc(arc), b""])))]
    assert [h["warc-type"] for h, _ in records] == ["warcinfo", "response", "response"]
    head, block = records[1]
    assert block == body and head["warc-date"] == "2024-01-02T03:04:05Z" and warc.page_of(head["warc-record-id"]) == -7 and head["warc-target-uri"] == "http://a%20b/"
    with pytest.raises(ValueError):
        [*warc.convert_arc(arc[:-3] + b"9\n")]


def test_identifiers():
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345):
        assert warc.page_of(warc.record_id(n)) == n
    assert warc.page_of(warc.other_id(b"x")) is None


def test_archives(spark, tmp_path):
    big = "é" * 600
    rows_ = [(1, "http://a/", big), (2, None, big), (3, "http://c/", big), (3, "http://c/", big), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (-8, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (9, "u", "y" * 100_000)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = collections.Counter((p, len((t or "").encode()), sha(t), "revisit" if p in (1, 2) else "response", 3 if p in (1, 2) else None) for p, _, t in rows_)
    assert got == want
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert not [*(tmp_path / "e").glob("*.gz")] or warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_connected_components(spark, monkeypatch):
    rng = random.Random(4)
    names = rng.sample(range(10**12), 900)
    edges = [(names[i], names[i + 1]) for i in range(300)] + [(names[301], names[i]) for i in range(302, 600)] + [(names[rng.randrange(600, 900)], names[rng.randrange(600, 900)]) for _ in range(200)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for least in (components_module.HOT_EDGES, 5):
        monkeypatch.setattr(components_module, "HOT_EDGES", least)
        got = [tuple(r) for r in components_module.connected_components(df).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert components_module.connected_components(df.limit(0)).count() == 0


def test_langid_rejects_unlearned_and_junk(spark, docs):
    """Long texts of letters in no learned language go; labelled documents stay."""
    model = langid.fit(langid.training_rows(spark.createDataFrame(docs)))
    rng = random.Random(6)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(chr(0x4E00 + i) for i in range(900))]
    junk = [" ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 9))) for _ in range(n)) for s in scripts for n in (10, 100, 1000) for _ in range(5)]
    assert langid.nearest(model, junk)[2].mean() > 0.95
    assert langid.nearest(model, docs["text"].tolist())[2].mean() < 0.02


def test_langid_is_the_nearest_centroid(spark, docs):
    model = langid.fit(langid.training_rows(spark.createDataFrame(docs)))
    lang, score, _ = langid.nearest(model, docs["text"].tolist())
    idf, centres = model["idf"].astype(float), model["centres"].astype(float)
    for t, got, s in zip(docs["text"][:40], lang, score, strict=False):
        x = np.log1p(langid.vectors([t])[0].astype(float)) * idf
        if x.any():
            cosines = centres @ (x / np.linalg.norm(x))
            assert cosines[[i for i, k in enumerate(model["of"]) if model["langs"][k] == got]].max() == pytest.approx(cosines.max(), abs=1e-5)
            assert s == pytest.approx(cosines.max(), abs=1e-5)


def test_quality_counts_documents_or_texts(documents):
    text = " ".join(f"w{i} and more" for i in range(12))
    rows_ = [(i, text, "en", "h") for i in range(30)]
    assert quality.quality(documents(rows_)).filter("kept").count() == 0
    assert quality.keep_good(documents(rows_), by_text=True).count() == 30


def brute_log_probability(p, classes):
    """Of each class given those before it in its window, one place at a time, in plain loops."""
    p = {k: v.astype(float) for k, v in p.items()}
    before = [lm.CLASSES - 1, *classes[:-1]]
    total = 0.0
    for i, target in enumerate(classes):
        k = 0 if i < attention.WINDOW else -(-(i + 1 - attention.WINDOW) // attention.STRIDE)
        ids = before[k * attention.STRIDE : i + 1]
        x = np.array([p["emb"][c] + p["pos"][j] for j, c in enumerate(ids)])
        weights = np.array([x[-1] @ p["wq"] @ (y @ p["wk"]) / np.sqrt(attention.DIM) for y in x])
        weights = np.exp(weights - weights.max())
        y = sum(w * (z @ p["wv"]) for w, z in zip(weights / weights.sum(), x, strict=True))
        h = np.maximum(np.concatenate([x[-1], y]) @ p["w1"] + p["b1"], 0)
        logits = h @ p["w2"] + p["b2"]
        total += logits[target] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
    return total


def test_score_is_the_brute_force_forward_pass():
    rng = np.random.default_rng(3)
    p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention.start(lm.CLASSES).items()}
    texts = [[*rng.integers(0, lm.CLASSES - 1, n).tolist(), lm.CLASSES - 1] for n in (0, 1, 5, 31, 32, 33, 100)]
    got = lm.score_texts(p, [bytes(t) for t in texts])
    assert got == pytest.approx([brute_log_probability(p, t) for t in texts], rel=1e-3)


def test_scores_do_not_depend_on_partitions(spark, docs):
    path = lm.vocabulary_path(lm.ENCODE_FILE)
    one = lm.score(spark.createDataFrame(docs).coalesce(1), path).toPandas().set_index("doc_id")
    eight = lm.score(spark.createDataFrame(docs).repartition(8), path).toPandas().set_index("doc_id").loc[one.index]
    assert np.allclose(one["score"], eight["score"], rtol=1e-3) and np.allclose(one["base_score"], eight["base_score"])


def test_training_gains(spark):
    """Twelve steps from the counts of pairs lower the loss of texts in which the class before the last one tells the next."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(300):
        x = [0, 1]
        while len(x) < 60:
            x.append(int((x[-2] * 3 + 1) % 7 if rng.random() < 0.9 else rng.integers(0, 7)))
        texts.append(bytes([*x, lm.CLASSES - 1]))
    pairs = np.zeros((lm.CLASSES, lm.CLASSES))
    for t in texts:
        for a, b in zip(bytes([lm.CLASSES - 1]) + t, t, strict=False):
            pairs[a, b] += 1
    start = lm.first_weights(pairs)
    flat = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, classes binary"), start)
    p = attention.unpack(flat, lm.CLASSES)
    assert lm.score_texts(p, texts).sum() > lm.score_texts(start, texts).sum()


def test_first_weights_follow_the_pairs():
    rng = np.random.default_rng(1)
    pairs = np.ones((lm.CLASSES, lm.CLASSES))
    pairs[np.arange(lm.CLASSES), rng.permutation(lm.CLASSES) % 5] += 5000
    p = lm.first_weights(pairs)
    texts = [bytes(rng.integers(0, lm.CLASSES, 400).tolist()) for _ in range(3)]
    before, after = np.frombuffer(bytes([lm.CLASSES - 1]) + texts[0][:-1], np.uint8), np.frombuffer(texts[0], np.uint8)
    given = np.log((pairs / pairs.sum(1, keepdims=True))[before, after]).sum()
    assert lm.score_texts(p, texts[:1])[0] == pytest.approx(given, rel=0.25)


def test_texts_are_read_as_all_ids_of_their_words():
    path = lm.vocabulary_path(lm.ENCODE_FILE)
    encode, size = lm.subwords(path)
    text = "the unbelievable Überlänge, the x"
    words = text.translate(LOWER).split(" ")
    head, none = np.sort(ngrams.word_hashes([b"the"])[0].view(np.int64)), np.zeros(size)
    model = {"path": path, "words": head, "counts": np.ones(1), "of": none.astype(int), "follow": none.astype(int), "follow_share": none, "first_share": none, "pairs": np.zeros(lm.PLACES * lm.FOLLOW * lm.FOLLOW)}
    model |= {"tail_log": np.zeros(lm.CLASSES), "head_of": np.zeros(1, int), "head_log": np.zeros(1), "head_ids": np.array(encode(" the"), lm.id_type(size + 1)), "head_starts": np.array([0, len(encode(" the"))])}
    rows_ = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "row": [1, 2], "held_out": [False, False], "text": [text.encode(), b""]})
    (got,) = lm._read(model)([rows_])
    runs = [[size], *(encode(" " + w) for w in words)]
    assert max(map(len, runs)) > 1
    ids = np.frombuffer(got["ids"][0].as_py(), lm.id_type(size + 1))
    assert ids.tolist() == [i for run in runs for i in run]
    assert np.unpackbits(np.frombuffer(got["opens"][0].as_py(), np.uint8), count=len(ids)).tolist() == [int(k == 0) for run in runs for k in range(len(run))]
    assert np.frombuffer(got["ids"][1].as_py(), lm.id_type(size + 1)).tolist() == [size] and got["opens"][1].as_py() == bytes([128])


def test_attention_reads_every_id_of_a_word():
    rng = np.random.default_rng(11)
    size = 700
    p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention.start(lm.CLASSES).items()}
    p["emb"] = rng.standard_normal((size + 1, attention.DIM)).astype(np.float32)
    words = [[size], *(rng.integers(0, size, n).tolist() for n in (1, 3, 2, 30, 1, 12, 13, 5))]
    classes = rng.integers(0, lm.CLASSES - 1, len(words)).astype(np.uint8)

    def score(words):
        opens = [k == 0 for w in words for k in range(len(w))]
        return lm.score_words(p, [(classes.tobytes(), np.array([i for w in words for i in w], lm.id_type(size + 1)).tobytes(), np.packbits(opens).tobytes())])[0]

    vectors = np.array([p["emb"][w[0]] + (p["emb"][w[1:]].mean(0) if len(w) > 1 else 0) for w in words])
    one = np.ones((1, len(words)), bool)
    want = attention.log_probabilities(p | {"emb": vectors}, np.arange(len(words))[None], classes[None].astype(int), one).sum()
    assert score(words) == pytest.approx(float(want), rel=1e-4)
    for w in range(1, len(words)):  # each id changes what follows
        for k in {0, len(words[w]) // 2, len(words[w]) - 1}:
            other = [list(x) for x in words]
            other[w][k] = (other[w][k] + 1) % size
            assert abs(score(other) - score(words)) > 1e-5
    ids, starts = np.array([i for w in words for i in w]), np.cumsum([0, *map(len, words)])[:-1]
    dx, back = rng.standard_normal((len(words), attention.DIM)), np.zeros((size + 1, attention.DIM))
    attention.embed_back(ids, starts, dx, back)
    some = rng.standard_normal(back.shape)
    assert (back * some).sum() == pytest.approx((attention.embed(some, ids, starts) * dx).sum())


def test_lm_writes_one_file_a_task(spark, sf, monkeypatch):
    """A file for each round and task made 13 times as many, and each file costs a process that changes its mode."""
    made = []

    def seen(df, *by):
        out = common.materialize(df, *by)
        if "round" in df.columns:
            made.append((len(out.inputFiles()), df.rdd.getNumPartitions(), out.filter("round < 12").select("round").distinct().count()))
        return out

    monkeypatch.setattr(lm, "materialize", seen)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = lm.score(docs, lm.vocabulary_path(lm.ENCODE_FILE))
    assert out.columns[:3] == ["doc_id", "held_out", "n_tokens"]
    ((files, tasks, rounds),) = made
    assert files <= tasks and rounds == 12
