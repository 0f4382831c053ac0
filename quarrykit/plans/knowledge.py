"""Store readers, detail joins, recall, rollups and small text rules of a knowledge base, over the given tables.

Conversations stand for messages, events for traces and feedback, documents for chunks and cards, embeddings for vectors of cards.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import recall as R
from ..operators import retrieval as X
from ..operators.nearest import nearest_phrase
from ..sources.tables import load
from .base import EVENTS, query


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%d_w%t%'")
def wildcard_like(spark, sf_dir):
    """Wildcards in what is searched for act."""
    return load(spark, sf_dir, "part").filter(F.col("p_name").ilike("%d_w%t%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'blue')")
def tag_membership(spark, sf_dir):
    return load(spark, sf_dir, "part").filter(F.array_contains(F.split("p_name", " "), "blue")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 7 <> 2")
def stale_documents(spark, sf_dir):
    """Rows that are not ready, or were cut by another version of the chunker."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 7).alias("chunker_version"))
    return R.stale(o, "o_orderstatus", "F", "chunker_version", 2).select("o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM customer WHERE c_acctbal > 5000) AS total FROM customer WHERE c_acctbal > 5000
    ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC, c_custkey DESC LIMIT 50 OFFSET 10""")
def page_with_total(spark, sf_dir):
    """A page in an order that puts what is true first, beside the number of all rows under the same filter."""
    c = load(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    page = c.orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), F.desc("c_custkey")).offset(10).limit(50)
    return page.crossJoin(F.broadcast(c.agg(F.count("*").alias("total")))).select("c_custkey", "c_mktsegment", "total")  # one row


@query(f"""WITH a AS (SELECT user_id, count(*) AS n, max(ts_ms) AS last FROM {EVENTS} WHERE event_type = 'click' GROUP BY 1)
    SELECT c_custkey, c_acctbal, coalesce(n, 0) AS applied FROM customer LEFT JOIN a ON user_id = c_custkey""")
def counter_bump(spark, sf_dir):
    """A counter as appended events that are counted on reading; nothing else of the row changes."""
    e = load(spark, sf_dir, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("applied"))
    return load(spark, sf_dir, "customer").join(e, "c_custkey", "left").select("c_custkey", "c_acctbal", F.coalesce("applied", F.lit(0)).alias("applied"))


@query(f"""WITH t AS (SELECT k AS conv_id, event_id AS trace, ts_ms FROM {EVENTS} WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts_ms DESC, event_id DESC) = 1),
    f AS (SELECT k AS conv_id, string_agg(event_type, ',' ORDER BY ts_ms, event_id) AS kinds FROM {EVENTS} WHERE event_type IN ('click', 'purchase') GROUP BY 1)
    SELECT c.conv_id, turn, role, coalesce(trace, -1) AS trace, coalesce(kinds, '') AS kinds, coalesce(d.source, 'none') AS title
    FROM conversations c LEFT JOIN t ON c.conv_id = t.conv_id LEFT JOIN f ON c.conv_id = f.conv_id LEFT JOIN documents d ON d.doc_id = t.trace % 1000""")
def conversation_detail(spark, sf_dir):
    """Messages with the last trace of each, the kinds of feedback in order of time, and the title of what the trace retrieved."""
    e = load(spark, sf_dir, "events").withColumnRenamed("k", "conv_id")
    traces = e.filter("event_type = 'view'").groupBy("conv_id").agg(F.max(F.struct("ts_ms", "event_id")).alias("t")).select("conv_id", F.col("t.event_id").alias("trace"))
    kinds = R.in_order(e.filter("event_type IN ('click', 'purchase')"), ["conv_id"], ["ts_ms", "event_id"], "event_type", "kinds")
    titles = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.col("source").alias("title"))
    out = load(spark, sf_dir, "conversations").join(traces, "conv_id", "left").join(kinds, "conv_id", "left").join(titles, F.col("trace") % 1000 == F.col("chunk"), "left")
    return out.select("conv_id", "turn", "role", F.coalesce("trace", F.lit(-1)).alias("trace"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"), F.coalesce("title", F.lit("none")).alias("title"))


@query("""WITH i AS (SELECT o_custkey AS insight, o_orderkey AS trace FROM orders), u AS (SELECT l_orderkey AS trace, l_partkey AS card FROM lineitem)
    SELECT insight, card, count(DISTINCT trace) AS traces FROM i JOIN u USING (trace) WHERE insight % 3 = 0 GROUP BY 1, 2""")
def insight_lineage(spark, sf_dir):
    """Insights to cards through the traces that an insight came from and the cards that a trace used, both held as arrays."""
    insights = load(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("insight")).agg(F.collect_set("o_orderkey").alias("traces"))
    traces = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace")).agg(F.collect_set("l_partkey").alias("cards"))
    return R.lineage(insights, "insight", "traces", traces, "trace", "cards").groupBy("insight", F.col("item").alias("card")).agg(F.countDistinct("trace").alias("traces"))


@query("""WITH s AS (SELECT l_partkey AS card, l_orderkey AS chunk, l_suppkey AS doc, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL),
    f AS (SELECT card, doc, min(pos) AS pos FROM s GROUP BY 1, 2) SELECT card, string_agg(doc, ',' ORDER BY pos, doc) AS documents FROM f GROUP BY 1""")
def card_documents(spark, sf_dir):
    """The distinct documents of each card's chunks, in the order in which its chunks name them."""
    x = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("card"), F.col("l_suppkey").alias("doc")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return R.in_order(x, ["card"], ["pos"], "doc", "documents").select("card", F.array_join("documents", ",").alias("documents"))


@query("""WITH p AS (SELECT label, vec_id AS phrase, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT vec_id, phrase, round(list_sum(list_transform(list_zip(v, q), lambda x: x[1] * x[2])), 6) AS cosine FROM c, p)
    SELECT vec_id, phrase, cosine FROM s WHERE cosine >= 0.2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, phrase) = 1""")
def semantic_assignment(spark, sf_dir):
    """The nearest phrase of each card, where it is near enough; phrases are the vectors whose id is divisible by 100."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    phrases = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("phrase"), F.col("v").alias("q"))
    return nearest_phrase(e, "vec_id", "v", phrases, 0.2)


@query(f"""WITH s AS (SELECT event_id, user_id, ts_ms FROM {EVENTS} WHERE event_type = 'view'), r AS (SELECT ts_ms AS run FROM {EVENTS} WHERE event_type = 'purchase')
    SELECT event_id, user_id, ts_ms FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE run - ts_ms BETWEEN 0 AND 60000)""")
def snapshots_without_run(spark, sf_dir):
    """Snapshots that no run follows within 60 seconds; both sides meet in buckets of that length."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts_ms", "event_type")
    return R.drop_followed(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'purchase'").select("ts_ms"), "ts_ms", 60_000)


@query("""WITH r AS (SELECT l_orderkey AS trace, l_linenumber - 1 AS pos, l_partkey AS chunk, l_quantity AS score FROM lineitem),
    j AS (SELECT r.*, p_name AS title FROM r LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON chunk = p_partkey)
    SELECT trace, string_agg(chunk || ':' || coalesce(title, '?'), ',' ORDER BY pos, chunk) AS retrieved FROM j GROUP BY 1""")
def trace_enrich(spark, sf_dir):
    """Traces whose retrieved items, an array, get titles; order and items without one stay."""
    item = F.struct((F.col("l_linenumber") - 1).alias("p"), F.col("l_partkey").alias("chunk"))
    traces = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace")).agg(F.sort_array(F.collect_list(item)).alias("retrieved"))
    titles = load(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("title"))
    out = R.enrich(traces, "trace", "retrieved", titles, "chunk")
    return out.select("trace", F.array_join(F.transform("retrieved", lambda x: F.concat(x["chunk"].cast("string"), F.lit(":"), F.coalesce(x["title"], F.lit("?")))), ",").alias("retrieved"))


@query("""SELECT o_custkey AS id, max(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_totalprice END) AS vec, max(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice END) AS fts FROM orders GROUP BY 1""")
def max_by_leg_family(spark, sf_dir):
    """The best score of an item over all legs of a family."""
    o = load(spark, sf_dir, "orders")
    best = lambda *prefixes: F.max(F.when(F.coalesce(*(F.when(F.col("o_orderpriority").startswith(p), True) for p in prefixes), F.lit(False)), F.col("o_totalprice")))
    return o.groupBy(F.col("o_custkey").alias("id")).agg(best("1", "2").alias("vec"), best("3").alias("fts"))


@query("""SELECT source, coalesce(round(avg(CASE WHEN quality = 1 THEN (doc_id % 100) END), 2), 0.0) AS score, count(quality) FILTER (quality = 1) AS measured FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def run_score(spark, sf_dir):
    """The mean over measured items only; 0 where none is measured."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    measured = F.col("quality") == 1
    return d.groupBy("source").agg(F.coalesce(F.round(F.avg(F.when(measured, F.col("doc_id") % 100)), 2), F.lit(0.0)).alias("score"), F.count(F.when(measured, 1)).alias("measured"))


@query("""WITH x AS (SELECT l_returnflag AS metric, l_orderkey, avg(l_quantity) FILTER (l_linenumber % 2 = 0) AS a, avg(l_quantity) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1, 2),
    d AS (SELECT metric, a - b AS d FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT metric, count(*) AS pairs, round(avg(d), 6) AS delta, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) >= 2 AS significant FROM d GROUP BY 1""")
def metric_significance(spark, sf_dir):
    """A paired t value for each metric, over items that both arms measured."""
    x = load(spark, sf_dir, "lineitem")
    arm = lambda r: F.avg(F.when(F.col("l_linenumber") % 2 == r, F.col("l_quantity")))
    d = x.groupBy(F.col("l_returnflag").alias("metric"), "l_orderkey").agg(arm(0).alias("a"), arm(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    t = F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))
    return d.groupBy("metric").agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 6).alias("delta"), F.round(t, 4).alias("t"), (F.abs(t) >= 2).alias("significant"))


@query(f"""SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS provider, CAST(sum(k) AS BIGINT) AS prompt, CAST(sum(k // 3) AS BIGINT) AS cached, least(1.0, round(sum(k // 3) / nullif(sum(k), 0), 6)) AS hit_rate
    FROM {EVENTS} WHERE ts_ms >= 1705276800000 GROUP BY ROLLUP (event_type)""")
def grand_total_cost(spark, sf_dir):
    """Sums by provider since a day, with a row for all; the overall rate is one sum over another, at most 1."""
    e = load(spark, sf_dir, "events").filter("ts_ms >= 1705276800000").withColumn("cached", F.floor(F.col("k") / 3))
    out = e.rollup("event_type").agg(F.grouping("event_type").alias("g"), F.sum("k").alias("prompt"), F.sum("cached").alias("cached"))
    rate = F.least(F.lit(1.0), F.round(F.col("cached") / F.nullif(F.col("prompt"), F.lit(0)), 6))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("provider"), "prompt", "cached", rate.alias("hit_rate"))


@query(f"SELECT ts_ms // 86400000 AS day, count(*) AS snapshots, round(avg(value), 6) AS mean_value, max_by(event_id, ts_ms * 1000000 + event_id) AS last FROM {EVENTS} WHERE event_type = 'signup' AND ts_ms >= 1704672000000 GROUP BY 1")
def snapshot_history(spark, sf_dir):
    """Snapshots since a time, by day."""
    e = load(spark, sf_dir, "events").filter("event_type = 'signup' AND ts_ms >= 1704672000000")
    return e.groupBy(F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.count("*").alias("snapshots"), F.round(F.avg("value"), 6).alias("mean_value"), F.max_by("event_id", F.struct("ts_ms", "event_id")).alias("last"))


@query("SELECT o_custkey AS run, count(*) AS total, CASE WHEN count(*) FILTER (o_totalprice > 1000) = 0 THEN 100.0 ELSE round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 1000) * 100.0::DOUBLE / count(*) FILTER (o_totalprice > 1000), 2) END AS percent FROM orders GROUP BY 1")
def progress_percent(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    asked = F.count_if(F.col("o_totalprice") > 1000)
    done = F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000))
    return o.groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("total"), F.when(asked == 0, 100.0).otherwise(F.round(done * 100.0 / asked, 2)).alias("percent"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(1 / (1 + list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS score FROM embeddings, q),
    o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 24),
    a AS (SELECT o.query_id, o.vec_id, score, (vec_id % 10) / 10.0::DOUBLE AS confidence FROM o WHERE score >= 0.35 AND vec_id % 10 >= 5 AND vec_id % 3 <> 0)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM a QUALIFY rank <= 6""")
def insight_recall(spark, sf_dir):
    """Active insights of enough confidence among the nearest, which are fetched four times over, then cut to six."""
    e = load(spark, sf_dir, "embeddings")
    near = X.knn(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "vec_id", "embedding", 24).drop("rank")
    state = e.select("vec_id", ((F.col("vec_id") % 10) / 10.0).alias("confidence"), F.when(F.col("vec_id") % 3 == 0, "candidate").otherwise("active").alias("status"))
    return R.recall(near.join(state, "vec_id"), "vec_id", least_score=0.35, least_confidence=0.5, limit=6).select("query_id", "vec_id", "score", "confidence", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(1 / (1 + list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS score FROM embeddings, q),
    o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 16), t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM o)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM t WHERE score >= top - 0.6 QUALIFY rank <= 4""")
def card_recall(spark, sf_dir):
    """The four nearest cards, of four times as many, that come near the best."""
    e = load(spark, sf_dir, "embeddings")
    near = X.knn(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "vec_id", "embedding", 16).drop("rank")
    return X.ranked(X.near_top(near, "score", 0.6).select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), F.asc("vec_id")], 4)


@query(r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ') AS normal FROM documents""")
def metric_normalize(spark, sf_dir):
    """Texts without ASCII punctuation, in lower case, with single spaces."""
    return load(spark, sf_dir, "documents").select("doc_id", T.without_punctuation(F.col("text")).alias("normal"))


RECALL = r"""q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS terms, item_id % 3 > 0 AS has_vector FROM benchmark),
    i AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[0-9a-z]+') AS terms, CASE WHEN turn % 3 = 2 THEN 'candidate' ELSE 'active' END AS status, (conv_id * 7 + turn * 3) % 20 / 20.0::DOUBLE AS confidence FROM conversations),
    g AS (SELECT * FROM i WHERE status = 'active' AND confidence >= 0.5),
    h AS (SELECT query_id, id, (id * 13 + query_id) % 100 / 100.0::DOUBLE AS score FROM q JOIN i ON query_id % 3 = 1 AND id % 11 = query_id % 11),
    v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 'vector' AS origin FROM h WHERE score >= 0.45 AND id IN (SELECT id FROM g) QUALIFY rank <= 3),
    s AS (SELECT * FROM g ORDER BY confidence DESC, id LIMIT 12), x AS (SELECT * FROM q WHERE {0}),
    t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS rank, 'terms' AS origin FROM x JOIN s ON len(list_filter(list_intersect(x.terms, s.terms), lambda w: w NOT IN ('the', 'that', 'in', 'of', 'to', 'and', 'is', 'an', 'on'))) > 0 QUALIFY rank <= 3)"""


def _recall(spark, sf_dir, index_empty):
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.latin_terms(F.col("text")).alias("terms"), (F.col("item_id") % 3 > 0).alias("has_vector"))
    i = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.latin_terms(F.col("text")).alias("terms"), F.when(F.col("turn") % 3 == 2, "candidate").otherwise("active").alias("status"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 20 / 20).alias("confidence"))
    h = q.filter("query_id % 3 = 1").select("query_id", (F.col("query_id") % 11).alias("m")).join(i.select("id", (F.col("id") % 11).alias("m")), "m")
    hits = h.select("query_id", "id", ((F.col("id") * 13 + F.col("query_id")) % 100 / 100).alias("score"))
    return R.recall_or_fall_back(q, hits, i, "id", index_empty, 3, generic=["the", "that", "in", "of", "to", "and", "is", "an", "on"])


@query("WITH " + RECALL.replace("{0}", "NOT has_vector") + " SELECT * FROM v UNION ALL SELECT * FROM t")
def insight_fallback(spark, sf_dir):
    """Insights by vector, or by shared terms for questions that have no vector; a question with a vector and nothing near gets none."""
    return _recall(spark, sf_dir, False)


@query("WITH " + RECALL.replace("{0}", "query_id NOT IN (SELECT query_id FROM h)") + " SELECT * FROM v UNION ALL SELECT * FROM t")
def insight_fallback_empty_index(spark, sf_dir):
    """The same while the index is still empty for some: all questions without hits fall back."""
    return _recall(spark, sf_dir, True)


MD = r"""(SELECT doc_id, '## Title ' || doc_id || chr(10) || '> **' || text || '** ![pic](http://x/' || doc_id || ') `code` #tag' || chr(10) || '```py' || chr(10) || '| a | b |' || chr(10) || '```' AS md FROM documents
    UNION ALL SELECT -1 - item_id, '# ' || chr(10) || '> ' || chr(10) || '```' FROM benchmark)"""


@query(rf"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '```[^\n]*', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(^|\s)#{{1,6}}\s', ' ', 'g'), '[*`~]+', '', 'g'), '[>|]+', ' ', 'g'),
        '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ') AS t FROM {MD})
    SELECT doc_id, nullif(CASE WHEN length(t) > 120 THEN rtrim(left(t, 119), ' ') || '…' ELSE t END, '') AS plain FROM p""")
def markdown_plain(spark, sf_dir):
    """Markdown as plain text in one line, cut to a limit that its ellipsis counts for; null where there is none."""
    d, b = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    md = F.concat(F.lit("## Title "), "doc_id", F.lit("\n> **"), "text", F.lit("** ![pic](http://x/"), "doc_id", F.lit(") `code` #tag\n```py\n| a | b |\n```"))
    rows = d.select("doc_id", md.alias("md")).unionByName(b.select((-1 - F.col("item_id")).alias("doc_id"), F.lit("# \n> \n```").alias("md")))
    return rows.select("doc_id", T.shortened(T.markdown_plain(F.col("md")), 120).alias("plain"))


#: Summaries: fenced, with a prefix, with both, with fences inside, empty.
SAID = """(SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '```md' || chr(10) || '摘要： ' || text || chr(10) || ' ```' WHEN 1 THEN ' 文档级上下文：上下文：' || text WHEN 2 THEN text || chr(10) || '```' || chr(10) || 'x' WHEN 3 THEN '```' || chr(10) || '```' ELSE text END AS s FROM conversations)"""


@query(rf"""WITH a AS (SELECT conv_id, turn, trim(s, {{0}}) AS t FROM {SAID}), b AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN trim(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(trim(x, {{0}}), '```')), chr(10)), {{0}}) ELSE t END AS t FROM a),
    c AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '文档级上下文：') THEN trim(substr(t, 8), {{0}}) ELSE t END AS t FROM b), d AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '上下文：') THEN trim(substr(t, 5), {{0}}) ELSE t END AS t FROM c),
    e AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '摘要：') THEN trim(substr(t, 4), {{0}}) ELSE t END AS t FROM d)
    SELECT conv_id, turn, nullif(left(trim(regexp_replace(t, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' '), 400), '') AS summary FROM e""".replace("{0}", "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"))
def clean_summary(spark, sf_dir):
    """A model's summary without fences and prefixes, in one line of at most 400 characters."""
    kind, text = F.col("turn") % 5, F.col("text")
    s = F.when(kind == 0, F.concat(F.lit("```md\n摘要： "), text, F.lit("\n ```"))).when(kind == 1, F.concat(F.lit(" 文档级上下文：上下文："), text)).when(kind == 2, F.concat(text, F.lit("\n```\nx"))).when(kind == 3, "```\n```").otherwise(text)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_summary(s, 400).alias("summary"))


#: A judge's answers: a score, broken off; dimensions; one of them out of range, or missing; a score out of range with good dimensions; none.
JUDGED = r"""(SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"score" : 0.' || (event_id % 90 + 10) || ', "note": "cut' WHEN 1 THEN '{"correctness": 0.5, "completeness": 1.0, "groundedness": 0.25, "standard_fit": 0' WHEN 2 THEN '{"correctness": 0.5, "completeness": 1.5, "groundedness": 0.25, "standard_fit": 0}'
    WHEN 3 THEN '{"correctness": 0.5, "completeness": 1}' WHEN 4 THEN '{"score": -3, "correctness": 1, "groundedness":1.0, "completeness": 0.125, "standard_fit": 0.5, "audit": {"score": 0.9}}' ELSE 'no json' END AS raw FROM events)"""
DIMENSIONS = {"correctness": 0.4, "groundedness": 0.3, "completeness": 0.2, "standard_fit": 0.1}
_FIRST = r"""(CASE WHEN try_cast(nullif(regexp_extract(raw, '"{0}"\s*:\s*(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) BETWEEN 0 AND 1 THEN try_cast(nullif(regexp_extract(raw, '"{0}"\s*:\s*(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) END)"""


@query(f"SELECT event_id, coalesce({_FIRST.replace('{0}', 'score')}, round(" + " + ".join(f"{w}::DOUBLE * {_FIRST.replace('{0}', k)}" for k, w in DIMENSIONS.items()) + f", 4)) AS score FROM {JUDGED}")
def judge_score(spark, sf_dir):
    """The score of a judge's answer, broken JSON too: its first one if that lies in 0..1, else the weighted dimensions if all do, else null."""
    n = F.col("event_id") % 6
    raw = (
        F.when(n == 0, F.concat(F.lit('{"score" : 0.'), F.col("event_id") % 90 + 10, F.lit(', "note": "cut')))
        .when(n == 1, '{"correctness": 0.5, "completeness": 1.0, "groundedness": 0.25, "standard_fit": 0')
        .when(n == 2, '{"correctness": 0.5, "completeness": 1.5, "groundedness": 0.25, "standard_fit": 0}')
        .when(n == 3, '{"correctness": 0.5, "completeness": 1}')
        .when(n == 4, '{"score": -3, "correctness": 1, "groundedness":1.0, "completeness": 0.125, "standard_fit": 0.5, "audit": {"score": 0.9}}')
        .otherwise("no json")
    )
    return load(spark, sf_dir, "events").select("event_id", T.salvaged_score(raw, "score", DIMENSIONS).alias("score"))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Definition' WHEN 1 THEN ' fact ' ELSE 'misc' END AS kind, p_size / 30.0::DOUBLE AS c, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS alias FROM part)
    SELECT p_partkey, CASE lower(trim(kind)) WHEN 'definition' THEN 'concept' WHEN 'fact' THEN 'fact' ELSE 'concept' END AS kind, round(CASE WHEN p_partkey % 7 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, c - 0.1)) END, 6) AS confidence, coalesce(alias, '') AS aliases FROM r""")
def normalize_extraction(spark, sf_dir):
    """Extracted items: synonyms of kinds, confidence within 0..1 (0.5 where absent), a scalar as a list."""
    r = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "Definition").when(F.col("p_partkey") % 3 == 1, " fact ").otherwise("misc").alias("kind"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 30.0 - 0.1).alias("confidence"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("aliases"),
    )
    out = R.normalized_items(r, {"definition": "concept", "fact": "fact"}, "concept")
    return out.select("p_partkey", "kind", F.round("confidence", 6).alias("confidence"), F.array_join("aliases", ",").alias("aliases"))


@query("""WITH m AS (SELECT l_orderkey AS id, list('c' || l_linenumber ORDER BY l_linenumber DESC) || list('c' || (l_linenumber + 2) ORDER BY l_linenumber) AS marks, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT id, array_to_string(list_transform(list_filter(list_distinct(marks), lambda x: CAST(substr(x, 2) AS INT) <= n), lambda x: x), ',') AS x, len(marks) AS given FROM m WHERE false
    UNION ALL SELECT id, array_to_string(list_sort(list_filter(list_distinct(marks), lambda x: CAST(substr(x, 2) AS INT) <= n)), ','), len(marks) FROM m""")
def resolve_markers(spark, sf_dir):
    """Markers tied to the chunks that they name; unknown ones go, and each stands once."""
    x = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linenumber").alias("l"), F.max("l_linenumber").alias("n"))
    marks = F.concat(F.transform("l", lambda i: F.concat(F.lit("c"), i)), F.transform("l", lambda i: F.concat(F.lit("c"), i + 2)))
    known = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("c"), i))
    return x.select("id", F.array_join(F.sort_array(R.known_markers(marks, known)), ",").alias("x"), F.size(marks).alias("given"))


@query("SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'About ' || lang ELSE '' END || chr(10) || left(text, 80) AS indexed FROM documents")
def index_prefix(spark, sf_dir):
    """What is indexed of a chunk: title, then the summary if there is one, then its text; the text itself stays as it is."""
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("About "), "lang"))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "source", summary, F.left("text", F.lit(80))).alias("indexed"))


@query("""WITH s AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, lang, source FROM documents) SELECT doc_id, n AS ordinal, 'summary' AS kind, 0 AS start, 0 AS "end", source || ' in ' || lang AS content FROM s
    UNION ALL SELECT doc_id, i - 1, 'body', 0, 0, md5(l[i]) FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)""")
def summary_chunk(spark, sf_dir):
    """A document's chunks and, after the last, one for its summary, which spans nothing."""
    d = load(spark, sf_dir, "documents")
    body = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "content")).select("doc_id", "ordinal", F.lit("body").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.md5("content").alias("content"))
    summaries = d.select("doc_id", F.concat("source", F.lit(" in "), "lang").alias("content"))
    return R.with_summaries(body, summaries, "doc_id")


@query(f"""WITH m AS (SELECT user_id, k % 9 AS marker, ts_ms, event_id FROM {EVENTS} WHERE event_type = 'click'), v AS (SELECT user_id, k % 9 AS marker FROM {EVENTS} WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT user_id, marker, min(ts_ms) AS at FROM m SEMI JOIN v USING (user_id, marker) GROUP BY 1, 2""")
def citation_emit(spark, sf_dir):
    """Each marker once for a message, at its first place, if it names something that was retrieved."""
    e = load(spark, sf_dir, "events").withColumn("marker", F.col("k") % 9)
    shown = e.filter("event_type = 'view'").select("user_id", "marker")
    return e.filter("event_type = 'click'").join(shown, ["user_id", "marker"], "left_semi").groupBy("user_id", "marker").agg(F.min("ts_ms").alias("at"))


@query(f"""WITH f AS (SELECT user_id, event_type, ts_ms, event_id FROM {EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS r FROM f WHERE event_type IN ('purchase', 'error', 'signup'))
    SELECT user_id, CASE event_type WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'archived' ELSE 'candidate' END AS status, ts_ms AS since FROM r WHERE r = 1""")
def lifecycle_state(spark, sf_dir):
    """The state of each insight after its last decision: promoted, archived, or made a candidate again."""
    e = load(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error', 'signup')")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts_ms", "event_id", "event_type")).alias("x"))
    state = F.when(F.col("x.event_type") == "purchase", "active").when(F.col("x.event_type") == "error", "archived").otherwise("candidate")
    return last.select("user_id", state.alias("status"), F.col("x.ts_ms").alias("since"))


@query("""WITH x AS (SELECT l_suppkey AS candidate, l_orderkey AS item, avg(l_quantity) FILTER (l_linenumber % 2 = 0) AS a, avg(l_quantity) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1, 2),
    y AS (SELECT candidate, count(*) AS items, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired, avg(a - b) AS delta, stddev_samp(a - b) AS sd FROM x GROUP BY 1)
    SELECT candidate, items, paired, CASE WHEN paired < greatest(1, items // 2) OR paired < 2 OR coalesce(sd, 0) = 0 THEN 'skipped' WHEN abs(delta) < 2 * sd / sqrt(paired) THEN 'undecided' WHEN delta > 0 THEN 'promote' ELSE 'archive' END AS verdict FROM y""")
def cycle_verdict(spark, sf_dir):
    """The verdict on each candidate from an A/B run: none where too few items are paired or the difference is not significant."""
    x = load(spark, sf_dir, "lineitem")
    arm = lambda r: F.avg(F.when(F.col("l_linenumber") % 2 == r, F.col("l_quantity")))
    items = x.groupBy(F.col("l_suppkey").alias("candidate"), F.col("l_orderkey").alias("item")).agg(arm(0).alias("a"), arm(1).alias("b"))
    return R.verdicts(items, "candidate")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def unregistered_ids(spark, sf_dir):
    """Ids that a store holds and the registry does not; only the key column is read."""
    return load(spark, sf_dir, "embeddings").select("vec_id").join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
