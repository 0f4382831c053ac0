import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrykit.functions import stats, text
from quarrykit.functions.sentences import headings, sentences
from quarrykit.operators import context, graph, lifecycle, relational, retrieval
from quarrykit.sources import sinks, tables
from quarrykit.streaming import flows


def one(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def legs(spark, **ranked):
    rows = [("q", i, leg, r + 1, x, 1.0) for i, (leg, ids) in enumerate(ranked.items()) for r, x in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, leg_ord int, leg string, rank int, id string, weight double")


def test_rrf(spark):
    got = {r["id"]: r["rrf"] for r in retrieval.rrf(legs(spark, vec=["x", "y"], fts=["y", "z"]), "id").collect()}
    assert got == {"x": pytest.approx(1 / 61, abs=1e-8), "y": pytest.approx(1 / 62 + 1 / 61, abs=1e-8), "z": pytest.approx(1 / 62, abs=1e-8)}


def test_rrf_ties_and_duplicates(spark):
    tied = retrieval.ranked(retrieval.rrf(legs(spark, vec=["x", "y"], fts=["y", "x"]), "id"), ["query_id"], [F.desc("rrf"), F.col("first")])
    assert [r["id"] for r in tied.orderBy("rank").collect()] == ["x", "y"]
    assert retrieval.rrf(legs(spark, vec=["a", "a", "a"]), "id").first()["rrf"] == pytest.approx(1 / 61, abs=1e-8)


def test_precision_at_k(spark):
    df = spark.createDataFrame([([False, False, True, True],), ([True, False],), ([],), ([False],)], "r array<boolean>").select(stats.precision_at_k(F.col("r")).alias("p"))
    assert [r["p"] for r in df.collect()] == [pytest.approx((1 / 3 + 2 / 4) / 2), 1.0, None, 0.0]


def test_paired_test_needs_two_pairs(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 30.0), ("b", 34.0), ("b", 32.0)], "arm string, delta double")
    got = {r["arm"]: r for r in df.groupBy("arm").agg(*(v.alias(k) for k, v in stats.paired_test(F.col("delta")).items())).collect()}
    assert got["a"]["significant"] is None and got["a"]["sd"] is None
    assert got["b"]["sd"] == 15.0 and got["b"]["significant"] is (32 / (15 / 3**0.5) >= 1.96 + 1.2)


def test_shares():
    assert context.shares([1, 1], [300, 300], 500, 200) == [250, 250]
    rng = random.Random(20240917)
    for _ in range(300):
        n = rng.randint(0, 12)
        weights, demands = [rng.random() + 0.01 for _ in range(n)], [rng.randint(0, 900) for _ in range(n)]
        budget, least = rng.randint(0, 3000), rng.randint(0, 300)
        out = context.shares(weights, demands, budget, least)
        assert sum(out) <= budget and all(0 <= a <= d for a, d in zip(out, demands, strict=True))


def test_sentences_lose_nothing():
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("ab .!?。！\n\"”)c") for _ in range(rng.randint(0, 80)))
        assert "".join(sentences(t)) == t


def test_headings_skip_fences():
    assert headings("# A\n```\n# no\n```\n## B\n") == [(0, "A"), (17, "A > B")]


def test_trim_overlap(spark):
    tail = "This sentence is in both of the chunks. "
    rows = [Row(query_id="q", pos=1, doc="d", ordinal=0, start=0, end=140, content="a" * 99 + ". " + tail), Row(query_id="q", pos=2, doc="d", ordinal=1, start=101, end=400, content=tail + "New words. " * 30)]
    got = {r["ordinal"]: r for r in context.trim_overlap(spark.createDataFrame(rows)).collect()}
    assert got[1]["content"] == "New words. " * 30 and got[1]["start"] == 101 + len(tail) and got[0]["content"] == rows[0]["content"]


def test_suppress_and_mmr(spark):
    df = spark.createDataFrame([("q", 1, "the same words again", 0.9), ("q", 2, "the same words again", 0.8), ("q", 3, "something else", 0.1)], "query_id string, pos int, content string, score double")
    assert sorted(r["pos"] for r in retrieval.suppress_redundant(df).collect()) == [1, 3]
    ids = lambda d: [r["content"] for r in d.orderBy("pos").collect()]
    assert ids(retrieval.mmr(df, "score", 1.0)) == ids(retrieval.mmr(df.withColumn("score", F.col("score") * 7), "score", 1.0)) == ["the same words again", "the same words again", "something else"]


def test_floor_is_skipped_below_confidence(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.05), ("b", 0.4), ("b", 0.01), ("c", 1.5), ("c", 0.01), ("d", None), ("d", 0.9)], "query_id string, score double")
    assert sorted((r["query_id"], r["score"]) for r in retrieval.relevance_floor(df, "score").collect() if r["score"] is not None) == [("a", 0.9), ("b", 0.01), ("b", 0.4), ("c", 0.01), ("c", 1.5), ("d", 0.9)]


def test_confidence_is_sticky_and_clamped(spark):
    rows = [(1, 1, "user_confirm", None), (1, 2, "user_confirm", None), (1, 3, "user_confirm", None), (1, 4, "negative_feedback", 1.0), (2, 1, "conflict", None), (2, 2, "user_confirm", None), (3, 1, "negative_feedback", 1.0), (3, 2, "negative_feedback", 0.5)]
    got = {r["id"]: (r["confidence"], r["status"]) for r in lifecycle.fold_confidence(spark.createDataFrame(rows, "id int, o int, event string, share double"), "id", "o").collect()}
    assert got == {1: (0.85, "active"), 2: (0.6, "conflicted"), 3: (0.075, "archived")}


def test_merge_extracted(spark):
    kind = "kind string, title string, body string, confidence double, verified boolean, sources array<string>"
    cards = spark.createDataFrame([("f", "a", "old", 0.5, False, ["1"]), ("f", "b", "mine", 0.5, True, ["1"])], kind)
    found = spark.createDataFrame([("f", "a", "new", 0.6, False, ["2"]), ("f", "b", "new", 0.9, False, ["1", "2"]), ("f", "c", "other", 0.1, False, ["3"])], kind)
    got = {r["title"]: (r["body"], r["sources"]) for r in lifecycle.merge_extracted(cards, found).collect()}
    assert got == {"a": ("new", ["1", "2"]), "b": ("mine", ["1", "2"]), "c": ("other", ["3"])}


def test_neighbourhood_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert dict(one(graph.neighbourhood(e, spark.createDataFrame([("a",)], "node string"), 2), "node", "depth")) == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_cursor_must_fit(spark):
    with pytest.raises(ValueError):
        relational.keyset_page(spark.range(3), [("id", False)], (1, 2), 5)


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "id int, created int, v int")
    new = spark.createDataFrame([(1, 99, 2), (3, 30, 2)], "id int, created int, v int")
    assert sorted(one(sinks.upsert(old, new, ["id"], "v", ["created"]), "id", "created", "v")) == [(1, 10, 2), (2, 20, 1), (3, 30, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "query_id string, pos int, content string, score double")
    assert retrieval.suppress_redundant(empty).count() == 0 and retrieval.near_top(empty, "score").count() == 0
    assert text.estimate_tokens(F.lit("")) is not None


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"  one\r\ntwo  \n")
    assert tables.read_text_documents(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"
    (tmp_path / "b.json").write_text('{"a": 1}\nbroken\n')
    assert sorted(str(r["a"]) for r in tables.jsonl(spark, str(tmp_path / "b.json"), "a int").collect()) == ["1", "None"]
    sinks.write_partition(spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string"), str(tmp_path / "t"), ["k"])
    sinks.write_partition(spark.createDataFrame([(3, "y")], "v int, k string"), str(tmp_path / "t"), ["k"])
    assert sorted(one(spark.read.parquet(str(tmp_path / "t")), "v", "k")) == [(1, "x"), (3, "y")]


def test_markers_do_not_depend_on_cuts():
    whole = "Text [^c1] and [^2], [not] one [^c12]."
    want, plain, tail = flows.take_markers(whole)
    assert [n for n, _ in want] == [1, 2, 12] and tail == "" and "^" not in plain
    for cut in range(len(whole)):
        a, p, t = flows.take_markers(whole[:cut])
        b, q, t = flows.take_markers(t + whole[cut:])
        assert a + [(n, o + len(p)) for n, o in b] == want and p + q == plain


def run_stream(spark, tmp_path, df, build, mode, name):
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / (name + "_ck"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streamed_depth_is_that_of_the_table(spark, sf, tmp_path):
    e = tables.load(spark, sf, "events").select("user_id", "event_type", F.struct("ts_ms", "event_id").alias("o"))
    status = F.when(F.col("event_type") == "view", "waiting").when(F.col("event_type") == "click", "running").otherwise("done")
    e = e.withColumn("status", status)
    got = run_stream(spark, tmp_path, e, lambda s: flows.ingest_depth(s, "user_id", "status", "o"), "complete", "depth")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flows.ingest_depth(e, "user_id", "status", "o").collect()))


def test_streamed_alerts(spark, sf, tmp_path):
    e = tables.load(spark, sf, "events").select(F.timestamp_millis("ts_ms").alias("at"), "event_type")
    got = run_stream(spark, tmp_path, e, lambda s: flows.alert_windows(s, "at", "event_type", F.col("event_type") == "error"), "update", "alerts")
    assert got.count() > 0 and got.filter("failures > calls").count() == 0


def test_streamed_confidence(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.createDataFrame([("a", "user_confirm", 1.0), ("a", "negative_feedback", 1.0), ("b", "eval_regressed", 1.0)], "key string, event string, share double")
    got = run_stream(spark, tmp_path, e, lambda s: s.groupBy("key").transformWithStateInPandas(flows.ConfidenceProcessor(), "key string, confidence double, archived boolean, n long", "Update", "None"), "update", "confidence")
    assert {r["key"]: (round(r["confidence"], 6), r["archived"], r["n"]) for r in got.collect()} == {"a": (0.45, False, 2), "b": (0.1, True, 1)}
