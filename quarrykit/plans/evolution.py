"""Evolution cycles: suppliers' nations are spaces, suppliers insights, order lines the scores of two arms."""

from pyspark.sql import functions as F

from ..operators import evolution as V
from ..operators.groups import dealt
from ..sources.tables import load
from .base import query

CYCLE = """i AS (SELECT s_nationkey AS space, s_suppkey AS id, round(abs(s_acctbal) % 100 / 100, 2)::DOUBLE AS confidence, CASE WHEN s_nationkey % 8 = 7 OR s_suppkey % 3 = 0 THEN 'active' ELSE 'candidate' END AS status FROM supplier),
    q AS (SELECT l_suppkey % 25 AS space, l_orderkey * 10 + l_linenumber AS item, min(l_quantity) AS l_quantity FROM lineitem WHERE l_suppkey % 25 <> 3 AND (l_suppkey % 25 <> 4 OR l_orderkey % 64 = 0) GROUP BY 1, 2),
    b AS (SELECT space, item, l_quantity * 2::DOUBLE AS a, l_quantity * 2::DOUBLE + (space % 5 - 2) * 6 + (item % 7 - 3) * 4 AS w FROM q WHERE space <> 5 OR item % 3 = 0),
    t AS (SELECT space, count(*) AS pairs, round(avg(w - a), 2) AS delta, count(*) >= 2 AND abs(avg(w - a) / (greatest(stddev_samp(w - a), 15.0) / sqrt(count(*)))) >= 1.96 + 2.4 / (count(*) - 1) AS sig FROM b GROUP BY 1),
    n AS (SELECT space, count(*) AS questions FROM q GROUP BY 1), c AS (SELECT space, count(*) FILTER (status = 'candidate') AS cand FROM i GROUP BY 1),
    v AS (SELECT space, CASE WHEN coalesce(questions, 0) = 0 THEN 'no_items' WHEN cand = 0 THEN 'no_candidates' WHEN coalesce(pairs, 0) < greatest(1, questions // 2) THEN 'too_few' WHEN NOT coalesce(sig, false) THEN 'noise' WHEN delta > 0 THEN 'improved' ELSE 'regressed' END AS verdict,
          coalesce(delta, 0.0) AS delta, coalesce(pairs, 0) AS pairs FROM c LEFT JOIN n USING (space) LEFT JOIN t USING (space)),
    u AS (SELECT i.*, verdict, delta, round(greatest(0.0, least(1.0, confidence + CASE verdict WHEN 'improved' THEN 0.2 ELSE -0.2 END)), 6)::DOUBLE AS c2, verdict IN ('improved', 'regressed') AND status = 'candidate' AS hit FROM i JOIN v USING (space)),
    x AS (SELECT *, CASE WHEN hit THEN CASE WHEN c2 < 0.15 THEN 'archived' WHEN verdict = 'improved' THEN 'active' ELSE status END ELSE status END AS s2 FROM u)"""


def _cycle(spark, sf_dir):
    s, x = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "lineitem")
    status = F.when((F.col("s_nationkey") % 8 == 7) | (F.col("s_suppkey") % 3 == 0), "active").otherwise("candidate")
    insights = s.select(F.col("s_nationkey").cast("long").alias("space"), F.col("s_suppkey").alias("id"), F.round(F.abs("s_acctbal") % 100 / 100, 2).cast("double").alias("confidence"), status.alias("status"))
    space = F.col("l_suppkey") % 25
    q = x.select(space.cast("long").alias("space"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity")).filter("space <> 3 AND (space <> 4 OR l_orderkey % 64 = 0)")
    q = dealt(q.drop("l_orderkey"), ["space", "item"]).groupBy("space", "item").agg(F.min("l_quantity").alias("l_quantity"))
    scores = q.select("space", "item", F.explode(F.array(F.lit("baseline"), F.lit("with_insights"))).alias("arm"), "l_quantity")
    better = (F.col("space") % 5 - 2) * 6 + (F.col("item") % 7 - 3) * 4
    scores = scores.select("space", "item", "arm", (F.col("l_quantity") * 2 + F.when(F.col("arm") == "baseline", 0).otherwise(better)).alias("score"), ((F.col("space") != 5) | (F.col("item") % 3 == 0) | (F.col("arm") == "baseline")).alias("measured"))
    return insights, V.verdicts(insights, q.select("space", "item"), scores)


@query(f"WITH {CYCLE} SELECT v.space, v.verdict, v.delta, v.pairs, count(*) FILTER (hit AND s2 = 'active') AS promoted, count(*) FILTER (hit AND s2 = 'archived') AS demoted FROM v LEFT JOIN x USING (space) GROUP BY 1, 2, 3, 4")
def evolution_runs(spark, sf_dir):
    """The verdict on each space's candidates, and how many it promoted and demoted."""
    insights, decided = _cycle(spark, sf_dir)
    return V.apply_verdicts(insights, decided)[2]


@query(f"WITH {CYCLE} SELECT space, id, CASE WHEN hit THEN c2 ELSE confidence END AS confidence, s2 AS status, CASE WHEN hit THEN delta END AS eval_delta FROM x")
def evolution_insights(spark, sf_dir):
    """Insights after the cycle: candidates of a decided space change, all others stay."""
    insights, decided = _cycle(spark, sf_dir)
    return V.apply_verdicts(insights, decided)[0]
