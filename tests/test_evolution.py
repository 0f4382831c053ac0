"""Consolidation plans and verdicts on small tables; the knowledge map's odd cases."""

from quarrykit.operators import evolution as V
from quarrykit.operators import lifecycle

PLAN = "space string, pos int, action string, keep string, ids array<string>, trigger string, guidance string, kind string"
INSIGHTS = "space string, id string, confidence double, status string, traces array<string>"


def test_consolidate(spark):
    rows = [("s", i, c, "candidate", t) for i, c, t in (("a", 0.3, ["1"]), ("b", 0.9, ["2", "1"]), ("c", 0.5, None), ("d", 0.4, []), ("e", 0.1, ["5"]), ("f", None, ["6"]), ("g", 0.2, ["7"]))] + [("t", "a", 0.7, "active", [])]
    plan = [
        ("s", 5, "conflict", None, ["e", "g", "a"], None, None, None),  # comes last, although it stands first
        ("s", 1, "duplicate", "a", ["a", "c", "c", "zz"], None, None, None),
        ("s", 2, "duplicate", "zz", ["d"], None, None, None),  # keep is not known
        ("s", 3, "merge", None, ["b", "a", "c", "f"], " when ", " do ", " odd "),
        ("s", 4, "merge", None, ["d", "a"], "x", "y", "constraint"),  # one is left
        ("s", 6, "merge", None, ["d", "e"], " ", "y", "constraint"),  # no trigger
        ("s", 7, "other", None, ["d"], None, None, None),
        ("u", 1, "duplicate", "a", ["b"], None, None, None),
        ("t", 1, "conflict", None, None, None, None, None),
    ]
    after, made = V.consolidate(spark.createDataFrame(rows, INSIGHTS), spark.createDataFrame(plan, PLAN))
    assert {(r["space"], r["id"]): r["status"] for r in after.collect()} == {("s", "a"): "archived", ("s", "b"): "archived", ("s", "c"): "archived", ("s", "d"): "candidate", ("s", "e"): "conflicted", ("s", "f"): "archived", ("s", "g"): "conflicted", ("t", "a"): "active"}
    m = made.collect()
    assert [(r["space"], r["status"], r["confidence"], r["traces"], r["trigger"], r["guidance"], r["kind"], r["of"]) for r in m] == [("s", "candidate", 0.9, ["2", "1", "6"], "when", "do", "heuristic", ["b", "a", "f"])]
    empty, none = V.consolidate(spark.createDataFrame(rows, INSIGHTS), spark.createDataFrame([], PLAN))
    assert empty.count() == 8 and none.count() == 0


def test_verdicts(spark):
    insights = spark.createDataFrame([(s, f"{s}{k}", c, st) for s in "abcdefg" for k, (c, st) in enumerate([(0.3, "candidate"), (0.95, "candidate"), (0.3, "conflicted"), (0.4, "active")])] + [("h", "h0", 0.5, "active")], "space string, id string, confidence double, status string")
    items = spark.createDataFrame([(s, i) for s in "bcdefgh" for i in range(8)], "space string, item int")
    shift = {"b": 0.0, "c": 40.0, "d": -40.0, "e": 40.0, "f": 40.0, "h": 40.0}
    scores = [(s, i, arm, 50.0 + i + (d if arm == "with_insights" else 0), not (s == "e" and i > 2 and arm == "baseline") and not (s == "f" and i > 3)) for s, d in shift.items() for i in range(8) for arm in ("baseline", "with_insights")]
    decided = V.verdicts(insights, items, spark.createDataFrame(scores, "space string, item int, arm string, score double, measured boolean"))
    assert {r["space"]: r["verdict"] for r in decided.collect()} == {"a": "no_items", "b": "noise", "c": "improved", "d": "regressed", "e": "too_few", "f": "improved", "g": "too_few", "h": "no_candidates"}
    after, events, runs = V.apply_verdicts(insights, decided)
    got = {r["id"]: (r["confidence"], r["status"], r["eval_delta"]) for r in after.collect()}
    assert got["c0"] == (0.5, "active", 40.0) and got["c1"] == (1.0, "active", 40.0) and got["c2"] == (0.3, "conflicted", None) and got["c3"] == (0.4, "active", None)
    assert got["d0"] == (0.1, "archived", -40.0) and got["d1"] == (0.75, "candidate", -40.0) and got["b0"] == (0.3, "candidate", None)
    assert {r["space"]: (r["promoted"], r["demoted"]) for r in runs.collect()} == {"a": (0, 0), "b": (0, 0), "c": (2, 0), "d": (0, 1), "e": (0, 0), "f": (2, 0), "g": (0, 0), "h": (0, 0)}
    assert events.count() == 6


def test_merged_sources_keep_their_order(spark):
    cards = spark.createDataFrame([("f", "a", "old", 0.5, False, ["z", "b"])], "kind string, title string, body string, confidence double, verified boolean, sources array<string>")
    found = spark.createDataFrame([("f", "a", "second", 0.8, False, ["y", "b"], 2), ("f", "a", "first", 0.8, False, ["x", "z"], 1)], "kind string, title string, body string, confidence double, verified boolean, sources array<string>, pos int")
    r = lifecycle.merge_extracted(cards, found).first()
    assert r["sources"] == ["z", "b", "x", "y"] and r["body"] == "first"
