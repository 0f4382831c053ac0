"""Evaluation statistics and the lifecycle of insights, over labels, events and lineitem."""

import math

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import evolution as V
from ..operators import lifecycle as L
from ..sources.tables import load
from .base import EVENTS, query

SEMI = "(SELECT l_orderkey AS id, list(l_returnflag <> 'N' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'N') AS r FROM lineitem GROUP BY 1)"


@query(f"""WITH e AS (SELECT id, unnest(r) AS v, generate_subscripts(r, 1) AS k FROM {SEMI}), c AS (SELECT *, sum(v::INT) OVER (PARTITION BY id ORDER BY k) AS h FROM e)
    SELECT id, round(CASE WHEN sum(v::INT) = 0 THEN 0.0 ELSE sum(CASE WHEN v THEN h * 1.0::DOUBLE / k ELSE 0 END) / sum(v::INT) END, 6) AS precision FROM c GROUP BY 1""")
def context_precision(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") != "N").alias("v")))).alias("r"))
    return items.select("id", F.round(S.precision_at_k(F.transform("r", lambda x: x["v"])), 6).alias("precision"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(lower(l), '[[:punct:]\s]+', ' ', 'g')) AS claim FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''),
    p AS (SELECT doc_id - 1 AS doc_id, list(DISTINCT claim) AS covered FROM c WHERE claim <> '' GROUP BY 1)
    SELECT c.doc_id, round(avg(CASE WHEN claim <> '' AND len(list_filter(coalesce(covered, []), lambda x: contains(x, claim) OR contains(claim, x))) > 0 THEN 1 ELSE 0 END), 4) AS recall FROM c LEFT JOIN p USING (doc_id) GROUP BY 1""")
def context_recall(spark, sf_dir):
    """The share of a document's lines (claims) that a line of the next document covers: equal, or one holds the other, after normalising."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.trim("l") != "")
    claims = lines.select("doc_id", F.trim(F.regexp_replace(F.lower("l"), r"[\p{Punct}\s]+", " ")).alias("claim"))
    covered = claims.filter("claim <> ''").groupBy((F.col("doc_id") - 1).alias("doc_id")).agg(F.collect_set("claim").alias("covered"))
    hit = (F.col("claim") != "") & F.exists(F.coalesce("covered", F.expr("array()").cast("array<string>")), lambda x: F.contains(x, F.col("claim")) | F.contains(F.col("claim"), x))
    return claims.join(covered, "doc_id", "left").groupBy("doc_id").agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4).alias("recall"))


@query("SELECT source, round(avg(quality), 4) AS faithfulness, count(quality) AS claims FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def faithfulness(spark, sf_dir):
    x = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.groupBy("source").agg(F.round(F.avg("quality"), 4).alias("faithfulness"), F.count("quality").alias("claims"))


DELTAS = """(SELECT a.l_suppkey % 10 AS arm, a.l_orderkey AS item, (b.l_quantity - a.l_quantity) * 2 AS delta FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"""
PAIRED = "count(delta) AS n, round(avg(delta), 6) AS mean_delta, round(greatest(stddev_samp(delta), {f}), 6) AS sd, round(avg(delta) / (greatest(stddev_samp(delta), {f}) / sqrt(count(delta))), 6) AS t, abs(avg(delta) / (greatest(stddev_samp(delta), {f}) / sqrt(count(delta)))) >= 1.96 + 2.4 / (count(delta) - 1) AS significant"


def _deltas(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    a = x.filter("l_linenumber = 1").select("l_orderkey", (F.col("l_suppkey") % 10).alias("arm"), F.col("l_quantity").alias("qa"))
    b = x.filter("l_linenumber = 2").select("l_orderkey", F.col("l_quantity").alias("qb"))
    return a.join(b, "l_orderkey").select("arm", F.col("l_orderkey").alias("item"), ((F.col("qb") - F.col("qa")) * 2).alias("delta"))


def _tested(df, by, floor=S.SD_FLOOR):
    t = S.paired_test(F.col("delta"), floor)
    return df.groupBy(*by).agg(*(F.round(v, 6).alias(k) if k in ("mean_delta", "sd", "t") else v.alias(k) for k, v in t.items()))


@query(f"SELECT arm, {PAIRED.format(f='15.0')} FROM {DELTAS} GROUP BY 1")
def paired_ttest(spark, sf_dir):
    return _tested(_deltas(spark, sf_dir), ["arm"])


@query(f"SELECT {PAIRED.format(f='0.0')}, round(2 * 15.0 / sqrt(count(delta)), 2) AS least_delta FROM {DELTAS}")
def paired_overall(spark, sf_dir):
    return _tested(_deltas(spark, sf_dir), [], 0.0).withColumn("least_delta", S.least_delta(F.col("n")))


@query(f"SELECT arm, round(-avg(delta), 6) AS contribution, count(*) FILTER (delta < 0) AS helped, count(*) FILTER (delta > 0) AS hurt, count(*) AS pairs FROM {DELTAS} GROUP BY 1")
def leave_one_out(spark, sf_dir):
    return _deltas(spark, sf_dir).groupBy("arm").agg(F.round(-F.avg("delta"), 6).alias("contribution"), F.count_if(F.col("delta") < 0).alias("helped"), F.count_if(F.col("delta") > 0).alias("hurt"), F.count("*").alias("pairs"))


@query("""WITH v AS (SELECT vec_id, label * 1000000 + vec_id // 20 AS probe, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.probe, round(avg(greatest(0, least(1, list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2]))))), 6) AS consistency, count(*) AS pairs FROM v a JOIN v b ON a.probe = b.probe AND a.vec_id < b.vec_id GROUP BY 1""")
def pairwise_consistency(spark, sf_dir):
    """Mean likeness of the answers to each probe; a probe here is a label's vectors of twenty neighbouring ids."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", (F.col("label").cast("long") * 1000000 + F.floor(F.col("vec_id") / 20)).alias("probe"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    b = v.select(F.col("vec_id").alias("other"), "probe", F.col("e").alias("f"))
    x = v.join(b, "probe").filter("vec_id < other")
    return x.groupBy("probe").agg(F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.dot(F.col("e"), F.col("f"))))), 6).alias("consistency"), F.count("*").alias("pairs"))


@query("""WITH m AS (SELECT source AS topic, count(*) AS n, avg(quality) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT topic, round(least(1.0, n / 3.0) * c, 3) AS mastery, n FROM m""")
def topic_mastery(spark, sf_dir):
    x = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic")).join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return x.groupBy("topic").agg(F.count("*").alias("n"), F.avg("quality").alias("c")).select("topic", F.round(F.least(F.lit(1.0), F.col("n") / 3.0) * F.col("c"), 3).alias("mastery"), "n")


@query(f"""WITH l AS (SELECT avg(quality) * 100 AS acc, count(*) FILTER (toxic = 0) * 100.0 / count(*) AS ground FROM labels), c AS (SELECT count(DISTINCT source) * 100.0 / 25 AS cov FROM documents JOIN labels USING (doc_id)),
    i AS (SELECT least(100.0, ln(1 + count(*)) / {math.log(41)!r} * 100) AS dens, count(*) FILTER (quality = 1) * 100.0 / count(*) AS cons FROM labels WHERE toxic = 0)
    SELECT round(0.35 * acc + 0.25 * ground + 0.2 * cov + 0.1 * cons + 0.1 * dens, 2) AS expertise FROM l, c, i""")
def expertise_index(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    a = labels.agg((F.avg("quality") * 100).alias("acc"), (F.count_if(F.col("toxic") == 0) * 100.0 / F.count("*")).alias("ground"))
    c = load(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id").agg((F.countDistinct("source") * 100.0 / 25).alias("cov"))
    i = labels.filter("toxic = 0").agg(S.density(F.count("*")).alias("dens"), (F.count_if(F.col("quality") == 1) * 100.0 / F.count("*")).alias("cons"))
    x = a.join(F.broadcast(c)).join(F.broadcast(i))
    return x.select(F.round(0.35 * F.col("acc") + 0.25 * F.col("ground") + 0.2 * F.col("cov") + 0.1 * F.col("cons") + 0.1 * F.col("dens"), 2).alias("expertise"))


def _ledger(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "view", "positive_feedback").when(F.col("event_type") == "error", "negative_feedback").when(F.col("event_type") == "purchase", "user_confirm").when(F.col("event_type") == "signup", "eval_regressed").otherwise("none")
    return e.select("user_id", F.struct("ts_ms", "event_id").alias("o"), event.alias("event"), (1.0 / (1 + F.col("k") % 3)).alias("share"))


@query(f"""WITH e AS (SELECT user_id, list({{'c': CASE event_type WHEN 'view' THEN 0.05 / (1 + k % 3) WHEN 'error' THEN -0.15 / (1 + k % 3) WHEN 'purchase' THEN 0.3 WHEN 'signup' THEN -0.2 ELSE 0.0 END::DOUBLE, 's': event_type}} ORDER BY ts_ms, event_id) AS d, count(*) AS n FROM {EVENTS} GROUP BY 1),
    f AS (SELECT user_id, n, list_reduce(d, lambda a, x: {{'c': greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.c + x.c)), 's': CASE WHEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.c + x.c)) < 0.15 THEN 'archived' WHEN x.s = 'purchase' THEN 'active' ELSE a.s END}}, {{'c': 0.3::DOUBLE, 's': 'candidate'}}) AS r FROM e)
    SELECT user_id, round(r.c, 6) AS confidence, r.s AS status, n FROM f""")
def confidence_fold(spark, sf_dir):
    return L.fold_confidence(_ledger(spark, sf_dir), "user_id", "o")


@query("SELECT l_orderkey AS trace, l_linenumber AS item, l_returnflag <> 'R' AS positive, round(1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def feedback_share(spark, sf_dir):
    return L.feedback_shares(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("item"), (F.col("l_returnflag") != "R").alias("positive")))


@query("""WITH p AS (SELECT l_suppkey AS id, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS phase, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'archived' WHEN l_returnflag = 'A' THEN 'merged' ELSE 'conflicted' END AS s FROM lineitem WHERE l_quantity > 49),
    f AS (SELECT id, min_by(s, (phase, pos)) AS s FROM p GROUP BY 1) SELECT s_suppkey AS id, coalesce(s, 'active') AS status FROM supplier LEFT JOIN f ON id = s_suppkey""")
def consolidate_plan(spark, sf_dir):
    flag = F.col("l_returnflag")
    plan = load(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("id"), F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2).alias("phase"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(flag == "R", "archived").when(flag == "A", "merged").otherwise("conflicted").alias("status"))
    return L.apply_plan(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("active").alias("status")), plan)


@query("""WITH s AS (SELECT doc_id, i - 1 AS line_no, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS a, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS b
      FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    o AS (SELECT doc_id, unnest(generate_series(100, length(text), 100)) AS p FROM documents)
    SELECT o.doc_id, p AS "at", min(line_no) AS line_no FROM o JOIN s ON s.doc_id = o.doc_id AND a <= p AND p <= b GROUP BY 1, 2""")
def range_groundedness(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    # spans of one document stand in one array, so offsets meet only their own document's spans
    at = F.when(F.length("text") >= 100, F.sequence(F.lit(100), F.length("text"), F.lit(100)))
    step = lambda s, x: F.struct(F.concat(s["e"], F.array(F.element_at(s["e"], -1) + 1 + F.length(x))).alias("e"))
    ends = F.aggregate(F.split("text", "\n"), F.struct(F.array(F.lit(-1)).alias("e")), step)["e"]
    x = d.withColumn("ends", F.filter(ends, lambda x: x >= 0)).withColumn("at", F.explode(at))
    return x.select("doc_id", F.col("at").cast("long").alias("at"), F.size(F.filter("ends", lambda e: e < F.col("at"))).cast("long").alias("line_no"))


@query(f"""WITH a AS (SELECT arm, avg(delta) AS m, count(*) FILTER (delta < 0) AS helped, count(*) FILTER (delta > 0) AS hurt, count(delta) AS pairs FROM {DELTAS} GROUP BY 1),
    f AS (SELECT round(greatest(abs(round(m, 2)), round(2 * 15.0 / sqrt(pairs), 2)), 2) AS noise_floor FROM a WHERE arm = 0)
    SELECT arm, round(-round(m, 2), 2) AS contribution, helped, hurt, pairs, noise_floor, abs(round(-round(m, 2), 2)) > noise_floor AS beyond_noise FROM a LEFT JOIN f ON true WHERE arm <> 0""")
def attribute_insights(spark, sf_dir):
    """What each insight contributes, told from arms that leave one out, against the noise of an arm that leaves out none."""
    return V.attribution(_deltas(spark, sf_dir).withColumn("delta", F.col("delta").cast("double")), 0)
