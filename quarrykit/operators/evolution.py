"""An evolution cycle over the insights of spaces: what evaluation decides about candidates, and what a consolidation plan does to insights."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import paired_test
from .groups import along_groups
from .lifecycle import ARCHIVE_BELOW, DELTAS, START

#: Kinds of insights, and the one that stands for an unknown kind.
KINDS, OTHER_KIND = ("correction", "preference", "heuristic", "constraint", "terminology"), "heuristic"


def verdicts(insights: DataFrame, items: DataFrame, scores: DataFrame) -> DataFrame:
    """(space, verdict, delta, pairs) for each space of insights(space, id, confidence, status).

    items(space, item) are its questions, scores(space, item, arm, score, measured) those of the arms baseline and with_insights. Only questions that both arms
    have measured count. The verdict is no_items or no_candidates where there is nothing to decide, too_few where less than half of the questions (one at least)
    are paired, noise where their differences are not significant, else improved or regressed.
    """
    arm = lambda name: scores.filter(F.col("measured") & (F.col("arm") == name)).select("space", "item", F.col("score").alias(name))
    paired = arm("baseline").join(arm("with_insights"), ["space", "item"])
    test = paired_test(F.col("with_insights") - F.col("baseline"))
    tested = paired.groupBy("space").agg(test["n"].alias("pairs"), F.round(test["mean_delta"], 2).alias("delta"), test["significant"].alias("significant"))
    asked = items.groupBy("space").agg(F.count("*").alias("questions"))
    pending = insights.groupBy("space").agg(F.count_if(F.col("status") == "candidate").alias("candidates"))
    out = pending.join(asked, "space", "left").join(tested, "space", "left")
    pairs = F.coalesce("pairs", F.lit(0))
    verdict = (
        F.when(F.coalesce("questions", F.lit(0)) == 0, "no_items")
        .when(F.col("candidates") == 0, "no_candidates")
        .when(pairs < F.greatest(F.lit(1), F.floor(F.col("questions") / 2)), "too_few")
        .when(~F.coalesce("significant", F.lit(False)), "noise")
        .when(F.col("delta") > 0, "improved")
        .otherwise("regressed")
    )
    return out.select("space", verdict.alias("verdict"), F.coalesce("delta", F.lit(0.0)).alias("delta"), pairs.alias("pairs"))


def apply_verdicts(insights: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(insights, events, runs) after verdicts(): candidates of a space gain or lose the confidence of its event, all or none; events tell what changed, runs how many
    were promoted and demoted."""
    d = decided.filter(F.col("verdict").isin("improved", "regressed")).select("space", F.concat(F.lit("eval_"), "verdict").alias("event"), "delta")
    step = F.when(F.col("event") == "eval_improved", DELTAS["eval_improved"]).otherwise(DELTAS["eval_regressed"])
    hit = F.col("event").isNotNull() & (F.col("status") == "candidate")
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + step))
    both = insights.join(d, "space", "left").withColumns({"__c": F.when(hit, F.round(new, 6)).otherwise(F.col("confidence")), "__hit": hit})
    both = both.withColumn("__s", F.when(F.col("__hit"), F.when(F.col("__c") < ARCHIVE_BELOW, "archived").when(F.col("event") == "eval_improved", "active").otherwise(F.col("status"))).otherwise(F.col("status")))
    after = both.select("space", "id", F.col("__c").alias("confidence"), F.col("__s").alias("status"), F.when(F.col("__hit"), F.col("delta")).alias("eval_delta"))
    events = both.filter("__hit").select("space", "id", "event", F.col("confidence").alias("confidence_before"), F.col("__c").alias("confidence_after"), F.col("status").alias("status_before"), F.col("__s").alias("status_after"))
    counts = events.groupBy("space").agg(F.count_if(F.col("status_after") == "active").alias("promoted"), F.count_if(F.col("status_after") == "archived").alias("demoted"))
    runs = decided.join(counts, "space", "left").na.fill(0, ["promoted", "demoted"])
    return after, events, runs


def consolidate(insights: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(insights, made) of insights(space, id, confidence, status, traces) after plan(space, pos, action, keep, ids, trigger, guidance, kind), all ids of one type.

    Of a space's plan duplicates come first, then merges, then conflicts, each by pos. A row is acted upon once; ids that the space has not are ignored.
    duplicate archives ids other than keep, if keep is known; merge archives two or more and makes a candidate with their greatest confidence and traces
    in order, if it has a trigger and guidance; conflict marks two or more. A plan is what one model call gives, and only the insights that it names meet it.
    """
    kind = insights.schema["id"].dataType.simpleString()
    named = plan.select("space", F.explode(F.concat(F.coalesce("ids", F.array().cast(f"array<{kind}>")), F.array_compact(F.array("keep")))).alias("id")).distinct()
    known = insights.join(named, ["space", "id"], "left_semi").groupBy("space").agg(F.collect_list(F.struct("id", "confidence", "traces")).alias("known"))
    phase = F.when(F.col("action") == "duplicate", 0).when(F.col("action") == "merge", 1).when(F.col("action") == "conflict", 2)
    rows = plan.withColumn("phase", phase).filter("phase IS NOT NULL").join(known, "space")
    space = insights.schema["space"].dataType.simpleString()
    traces = insights.schema["traces"].dataType.simpleString()

    def step(entries):
        have = {k["id"]: k for k in entries[0]["known"]}
        touched, out = set(), []

        def mark(ids, status):
            touched.update(ids)
            out.extend({"space": entries[0]["space"], "id": i, "status": status} for i in ids)

        for e in entries:
            free = [i for i in dict.fromkeys(e["ids"] or []) if i in have and i not in touched]
            if e["phase"] == 0 and e["keep"] in have:
                mark([i for i in free if i != e["keep"]], "archived")
            elif e["phase"] == 1 and len(free) > 1 and (e["trigger"] or "").strip() and (e["guidance"] or "").strip():
                seen = list(dict.fromkeys(t for i in free for t in have[i]["traces"] or []))
                best = max((have[i]["confidence"] for i in free if have[i]["confidence"] is not None), default=START)
                named = (e["kind"] or "").strip()
                out.append({"space": e["space"], "status": "candidate", "confidence": best, "traces": seen, "trigger": e["trigger"].strip(), "guidance": e["guidance"].strip(), "kind": named if named in KINDS else OTHER_KIND, "of": free})
                mark(free, "archived")
            elif e["phase"] == 2 and len(free) > 1:
                mark(free, "conflicted")
        return out

    schema = f"space {space}, id {kind}, status string, confidence double, traces {traces}, trigger string, guidance string, kind string, of array<{kind}>"
    acts = along_groups(rows, ["space"], ["phase", "pos"], step, schema)
    marks = acts.filter("id IS NOT NULL").select("space", "id", F.col("status").alias("__s"))
    after = insights.join(marks, ["space", "id"], "left").withColumn("status", F.coalesce("__s", "status")).drop("__s").select(*insights.columns)
    return after, acts.filter("id IS NULL").drop("id")


def attribution(deltas: DataFrame, same: str | int, by: str = "arm") -> DataFrame:
    """(arm, contribution, helped, hurt, pairs, noise_floor, beyond_noise) of deltas(arm, item, delta), the change of each question's score when the arm's insight is
    left out; delta may be null where one side was not measured. ``same`` is the arm that left nothing out: what it differs by, and no less than what so many
    questions can tell apart at all, is the noise floor, null without such an arm."""
    from ..functions.stats import least_delta

    d = F.col("delta")
    sums = deltas.groupBy(by).agg(F.avg(d).alias("mean"), F.count_if(d < 0).alias("helped"), F.count_if(d > 0).alias("hurt"), F.count(d).alias("pairs"))
    floor = sums.filter(F.col(by) == same).select(F.round(F.greatest(F.abs(F.round("mean", 2)), least_delta(F.col("pairs"))), 2).alias("noise_floor"))
    out = sums.filter(F.col(by) != same).join(F.broadcast(floor), how="left")  # one row at most
    contribution = F.round(-F.round("mean", 2), 2)
    return out.select(by, contribution.alias("contribution"), "helped", "hurt", "pairs", "noise_floor", (F.abs(contribution) > F.col("noise_floor")).alias("beyond_noise"))
