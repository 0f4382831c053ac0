"""Confidence as a fold over events, credit for feedback, and plans that are applied once to each row."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Changes of confidence by event (fixed values), the start, and where a row is archived.
DELTAS = {"user_confirm": 0.30, "positive_feedback": 0.05, "negative_feedback": -0.15, "eval_improved": 0.20, "eval_regressed": -0.20}
START, ARCHIVE_BELOW = 0.3, 0.15
SHARED = ("positive_feedback", "negative_feedback")


def fold_confidence(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, confidence, status, n) of events(key, order, event, share): each step adds its delta and is clamped to 0..1.

    A row is archived below ARCHIVE_BELOW, active after a confirmation or an improvement, and stays conflicted once it is. The clamp makes
    steps depend on their order, so a key's events are folded as one sorted array (a key's ledger is short).
    """
    delta = F.element_at(F.create_map(*(F.lit(x) for pair in DELTAS.items() for x in pair)), F.col("event"))
    step = F.struct(F.col(order).alias("o"), (F.coalesce(delta, F.lit(0.0)) * F.when(F.col("event").isin(*SHARED), F.coalesce("share", F.lit(1.0))).otherwise(1.0)).alias("d"), F.col("event").alias("e"))

    def advance(state: Column, x: Column) -> Column:
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), state["c"] + x["d"]))
        status = F.when((state["s"] == "conflicted") | (x["e"] == "conflict"), "conflicted").when(c < ARCHIVE_BELOW, "archived").when(x["e"].isin("user_confirm", "eval_improved"), "active").otherwise(state["s"])
        return F.struct(c.alias("c"), status.alias("s"))

    start = F.struct(F.lit(START).alias("c"), F.lit("candidate").alias("s"))
    out = events.groupBy(key).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    out = out.withColumn("end", F.aggregate("steps", start, advance))
    return out.select(key, F.round("end.c", 6).alias("confidence"), F.col("end.s").alias("status"), F.size("steps").cast("long").alias("n"))


def feedback_shares(used: DataFrame) -> DataFrame:
    """used(trace, item, positive) with share, the trace's credit dealt evenly among its items."""
    return used.withColumn("share", F.round(1 / F.count("*").over(Window.partitionBy("trace")), 6))


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(id, status) after plan(phase, pos, id, status): the first entry of an id counts, unknown ids are ignored."""
    first = plan.groupBy("id").agg(F.min_by(F.col("status"), F.struct("phase", "pos")).alias("__new"))
    return rows.join(first, "id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def merge_extracted(cards: DataFrame, found: DataFrame) -> DataFrame:
    """cards(kind, title, body, confidence, verified, sources) after found of the same columns: sources are united; the body of greater confidence wins
    strictly, and never over a verified one. Titles match as they stand. Sources keep the order in which they are first seen: those of the card, then those found, by the
    column pos of found if it has one; of equal confidences the first body stays."""
    at = F.col("pos") if "pos" in found.columns else F.lit(0)
    more = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("pos"), "sources"))), lambda x: x["sources"])))
    best = found.groupBy("kind", "title").agg(F.max_by(F.struct("body", "confidence"), F.struct("confidence", (-at).alias("first"))).alias("b"), more.alias("more"))
    both = cards.join(best, ["kind", "title"], "full_outer")
    wins = F.col("confidence").isNull() | (~F.coalesce("verified", F.lit(False)) & (F.coalesce(F.col("b.confidence"), F.lit(-1.0)) > F.col("confidence")))
    return both.select(
        "kind", "title", F.when(wins, F.col("b.body")).otherwise(F.col("body")).alias("body"), F.when(wins, F.col("b.confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("verified", F.lit(False)).alias("verified"), F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("sources"),
    )


def prune_references(rows: DataFrame, gone: DataFrame, column: str, drop_orphans: bool) -> DataFrame:
    """rows without the references that gone(ref) lists; rows that lose their last one go too if asked for. Works on long lists of gone by a join."""
    keyed = rows.withColumn("__row", F.xxhash64(*rows.columns))
    hit = keyed.select("__row", F.explode(column).alias("ref")).join(gone.select("ref").distinct(), "ref").groupBy("__row").agg(F.collect_set("ref").alias("__gone"))
    out = keyed.join(hit, "__row", "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column)).otherwise(F.filter(column, lambda x: ~F.array_contains("__gone", x))))
    if drop_orphans:
        out = out.filter(F.col("__gone").isNull() | (F.size(column) > 0))
    return out.select(*rows.columns)
