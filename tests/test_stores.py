"""Broken JSON, kept scores, stages that go on, secrets: odd cases and brute force."""

import json

import pytest
from pyspark.sql import functions as F

from quarrykit.functions import redact
from quarrykit.operators import salvage, scores, stages

WHOLE = {"note": "a ] } [ {", "cards": [{"t": 'x"y', "l": [1, {"z": "}"}]}, {"t": "b\\", "n": None}, {"t": "c"}], "more": [{"k": 1}], "n": 3}


def test_every_cut():
    text = json.dumps(WHOLE)
    ends = {f: [text.index(json.dumps(e), text.index(f'"{f}"')) + len(json.dumps(e)) for e in WHOLE[f]] for f in ("cards", "more")}
    for cut in range(len(text)):
        want = [(f, e) for f in ("cards", "more") for e, end in zip(WHOLE[f], ends[f]) if end <= cut]
        assert [(f, json.loads(e)) for f, e in salvage.closed_elements("Answer: " + text[:cut])] == want


@pytest.mark.parametrize("text, want", [("", []), ("[1, 2", []), ('{"a": [1, [2], "x"', []), ('{"a": {"b": [{"c": 1}]}', []), ('{"a": [{"b": bad}, {"c": 1}', [("a", '{"c": 1}')]), ('{"a": [{"b": 1}]} {"c": [{"d": 2}', [("a", '{"b": 1}')])])
def test_odd_texts(text, want):
    assert salvage.closed_elements(text) == want


def test_items(spark):
    rows = [(1, json.dumps(WHOLE)), (2, "```json\n" + json.dumps(WHOLE) + "\n```"), (3, "So: " + json.dumps(WHOLE) + " done"), (4, json.dumps(WHOLE)[:-30]), (5, '[{"items": 1}]'), (6, None), (7, ""), (8, "no json"), (9, '{"cards": "none"}'), (None, '{"cards": [{"t": 1}, 5, "x"]}')]
    got = salvage.items(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", ["cards", "items"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        by.setdefault((r["id"], r["field"], r["how"]), []).append(json.loads(r["item"]))
    assert by[1, "cards", "parsed"] == by[2, "cards", "parsed"] == by[3, "cards", "parsed"] == WHOLE["cards"] == by[4, "cards", "salvaged"]
    assert by[5, "items", "parsed"] == [{"items": 1}] and by[None, "cards", "parsed"] == [{"t": 1}, 5, "x"]
    assert {k[0] for k in by} == {None, 1, 2, 3, 4, 5}


def test_cards(spark):
    good = {"kind": " Concept ", "title": "t", "body": " b "}
    items = [good, good | {"kind": "陷阱", "confidence": "0.7"}, good | {"confidence": 7}, good | {"confidence": True}, good | {"confidence": "x"}, good | {"kind": "faq"}, good | {"title": ""}, {"kind": "fact"}, 5, good | {"title": 5}]
    items += [good | {"aliases": [" a ", None, 3, ""], "source_chunk_markers": "c1"}, good | {"aliases": 7}]
    df = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(items)] + [(1, 99, "{broken")], "id long, pos int, item string")
    got = {r["pos"]: r for r in salvage.cards(df, ["id"]).collect()}
    assert [i for i in sorted(got) if got[i]["ok"]] == [0, 1, 2, 3, 4, 10, 11]
    assert [got[i]["confidence"] for i in range(5)] == [0.5, 0.7, 1.0, 0.5, 0.5]
    assert got[0]["kind"] == "concept" and got[1]["kind"] == "pitfall" and got[0]["body"] == " b "
    assert got[10]["aliases"] == ["a", "3"] and got[10]["markers"] == ["c1"] and got[11]["aliases"] == []


def test_scores(spark):
    pairs = scores.keyed(spark.createDataFrame([(1, "q", "a"), (2, "q", "a"), (3, "q", "b"), (4, "r", "a"), (5, None, None)], "id long, query string, text string"), "m")
    calls = []

    def score(rows):
        calls.append(rows.count())
        return rows.withColumn("score", F.when(F.col("query") == "q", F.length("text").cast("double")))

    empty = spark.createDataFrame([], scores.SCHEMA)
    first = scores.refreshed(empty, pairs, score, 1)
    assert calls == [4] and first.count() == 2  # equal texts are one pair; what has no score is not kept
    second = scores.refreshed(first, pairs.filter("query = 'q'"), score, 2)
    assert calls == [4, 0] and {r["used"] for r in second.collect()} == {2}
    third = scores.refreshed(second, pairs.filter("id = 3"), score, 3, most=1)
    assert [r["used"] for r in third.collect()] == [3]
    ranked = {r["id"]: (r["origin"], r["rank"]) for r in scores.reranked(pairs.filter("id <> 5"), third, ["query"], [F.asc("id")], 5).collect()}
    assert ranked == {3: ("score", 1), 4: ("fallback", 1)}


def test_stages_go_on(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(i)) for i in range(20)], "id long, text string")
    broken = {"on": True}

    def step(row):
        if row["id"] == 7:
            raise ValueError("seven")
        return {"n": int(row["text"]) * 2}

    first = stages.Stage("double", stages.each_row(step, "id", "n long"))

    def killed(df):
        if broken["on"]:
            raise KeyboardInterrupt
        return stages.each_row(lambda r: {"m": r["n"] + 1}, "id", "m long")(df)

    steps, path = [first, stages.Stage("plus", killed)], str(tmp_path / "a")
    with pytest.raises(KeyboardInterrupt):
        stages.run_stages(docs, "id", steps, path)
    parts = sorted(p.name for p in (tmp_path / "a" / "double").glob("*.parquet"))
    broken["on"] = False
    state = {r["id"]: tuple(r)[1:] for r in stages.run_stages(docs, "id", steps, path).collect()}
    assert sorted(p.name for p in (tmp_path / "a" / "double").glob("*.parquet")) == parts  # what was done is not done again
    assert state.pop(7) == ("failed", "double", "ValueError: seven") and set(state.values()) == {("ready", "plus", None)}
    whole = stages.run_stages(docs, "id", steps, str(tmp_path / "b"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, stages.run_stages(docs, "id", steps, path).collect()))
    assert {r["id"]: r["m"] for r in stages.results(spark, "id", "plus", path).collect()} == {i: 2 * i + 1 for i in range(20) if i != 7}
    # a retry takes up the failed one alone; new documents are taken up as they come
    mended = [stages.Stage("double", stages.each_row(lambda r: {"n": 2 * r["id"]}, "id", "n long")), steps[1]]
    more = docs.union(spark.createDataFrame([(50, "50")], docs.schema))
    assert {r["status"] for r in stages.run_stages(more, "id", mended, path, retry=True).collect()} == {"ready"}
    assert sorted(r["id"] for r in spark.read.parquet(path + "/double").filter("attempt > 0").collect()) == [7, 50]


def test_secrets(spark):
    df = spark.sql(
        """SELECT 1 AS id, 'x' AS Token, named_struct('API_KEY', 5, 'deep', array(named_struct('secret', array(1, 2), 'ok', 'v'), NULL)) AS s, map('password', map('a', 1), 'b', map('c', 2)) AS m, map(1, named_struct('apikey', 'k')) AS n,
        named_struct('loc', array('body', NULL, 'Password'), 'input', named_struct('a', 1)) AS e, named_struct('loc', array('body'), 'input', 'plain') AS f, parse_json('{"a": [{"Authorization": {"x": 1}, "b": 2}]}') AS v
        UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""
    )
    got = {r["id"]: r for r in redact.redacted(df).withColumn("v", F.to_json("v")).collect()}
    r = got[1]
    assert r["Token"] == "***" and r["s"]["API_KEY"] == "***" and r["s"]["deep"][0]["secret"] == "***" and r["s"]["deep"][0]["ok"] == "v" and r["s"]["deep"][1] is None
    assert r["m"] == {"password": None, "b": {"c": 2}} and r["n"][1]["apikey"] == "***"
    assert r["e"]["input"] == "***" and r["f"]["input"] == "plain" and json.loads(r["v"]) == {"a": [{"Authorization": "***", "b": 2}]}
    assert all(x is None for x in tuple(got[2])[1:])
    texts = spark.createDataFrame([('{"a": {"TOKEN": [1]}}',), ("[broken",), (None,), ('"token"',)], "t string").select(redact.masked_json(F.col("t")).alias("x"))
    assert [x["x"] for x in texts.collect()] == ['{"a":{"TOKEN":"***"}}', None, None, '"token"']
