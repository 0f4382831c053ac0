"""Filters, pages, joins, rollups and writes over the relational tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import sinks
from ..sources.tables import load
from .base import EVENTS, query


def _usage(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_type", "user_id", "ts_ms", F.coalesce("k", F.lit(0)).alias("prompt"), F.floor("value").cast("long").alias("completion"), (F.coalesce("k", F.lit(0)) % 7).alias("cached"), F.col("value").alias("latency"))


USAGE = f"(SELECT event_type, user_id, ts_ms, coalesce(k, 0) AS prompt, CAST(floor(value) AS BIGINT) AS completion, coalesce(k, 0) % 7 AS cached, value AS latency FROM {EVENTS})"


@query(f"""SELECT event_type AS key, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(cached) AS BIGINT) AS cached,
    round(avg(latency), 6) AS avg_latency, CAST(sum(prompt) + sum(completion) AS BIGINT) AS total,
    round(CASE WHEN sum(prompt) > 0 THEN least(sum(cached) / sum(prompt), 1.0) ELSE 0.0 END, 6) AS hit_rate
    FROM {USAGE} WHERE event_type IS NOT NULL AND ts_ms >= 1704672000000 GROUP BY 1""")
def usage_rollup_by_type(spark, sf_dir):
    return R.usage_rollup(_usage(spark, sf_dir).filter(F.col("ts_ms") >= 1704672000000), "event_type")


@query(f"""WITH w AS (SELECT * FROM {EVENTS} WHERE ts_ms >= (SELECT max(ts_ms) FROM {EVENTS}) - 172800000)
    SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) AS calls, max(ts_ms) FILTER (event_type = 'error') AS last_failed,
    max(ts_ms) FILTER (event_type <> 'error') AS last_ok, coalesce(max(ts_ms) FILTER (event_type <> 'error') > max(ts_ms) FILTER (event_type = 'error'), false) AS recovered
    FROM w GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0""")
def provider_alerts(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    last = e.agg(F.max("ts_ms").alias("last"))
    recent = e.join(F.broadcast(last)).filter(F.col("ts_ms") >= F.col("last") - 172_800_000)
    return R.failure_alerts(recent, "user_id", "ts_ms", F.col("event_type") == "error")


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS total_tokens, count(*) AS n FROM " + EVENTS + " WHERE ts_ms >= 1706000000000")
def total_tokens(spark, sf_dir):
    return load(spark, sf_dir, "events").filter(F.col("ts_ms") >= 1706000000000).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total_tokens"), F.count("*").alias("n"))


@query(f"SELECT user_id, event_id, event_type, ts_ms FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return R.latest_per_key(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts_ms"), ["user_id"], ["ts_ms", "event_id"])


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND (o_totalprice < 200000.0 OR (o_totalprice = 200000.0 AND o_orderkey < 100)))
    ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.keyset_page(o, [("o_orderpriority", False), ("o_totalprice", True), ("o_orderkey", True)], ("2-HIGH", 200000.0, 100), 50)


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def id_cursor_page(spark, sf_dir):
    return R.keyset_page(load(spark, sf_dir, "documents").select("doc_id", "source"), [("doc_id", False)], (100,), 25)


@query("SELECT l_partkey AS part, count(*) AS mentions FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_by_mention(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "part").limit(20)


@query("""SELECT s_suppkey, s_name, s_acctbal FROM (SELECT *, s_suppkey IN (3, 7) AS pin FROM supplier) ORDER BY pin DESC, s_acctbal DESC, s_suppkey LIMIT 10""")
def top_with_pinned(spark, sf_dir):
    return R.top_with_pinned(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], "s_suppkey", [3, 7], 10)


@query("""SELECT l_suppkey AS id, count(*) AS applied, count(*) FILTER (l_returnflag = 'R') AS success FROM lineitem GROUP BY 1
    HAVING count(*) >= 5 AND count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*) <= 0.4 ORDER BY count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*), count(*) DESC, id LIMIT 20""")
def review_candidates(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("applied"), F.count_if(F.col("l_returnflag") == "R").alias("success"))
    return x.filter("applied >= 5 AND success * 1.0 / applied <= 0.4").orderBy(F.expr("success * 1.0 / applied"), F.desc("applied"), "id").limit(20)


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'page=2&')")
def literal_like(spark, sf_dir):
    return load(spark, sf_dir, "pages").filter(R.literal_like(F.col("url"), "Page=2&")).select("page_id", "url")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2', 'src3') AND n_chars >= 1000")
def optional_filters(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    wanted = {"lang": F.col("lang") == "fr", "source": F.col("source").isin("src1", "src2", "src3"), "least": F.col("n_chars") >= 1000}
    for condition in wanted.values():
        d = d.filter(condition)
    return d.select("doc_id", "source", "lang", "n_chars")


@query("SELECT source, count(*) AS pending, CAST(sum(toxic) AS BIGINT) AS toxic, round(avg(quality), 6) AS quality FROM labels JOIN documents USING (doc_id) WHERE source <> 'src0' GROUP BY 1")
def feedback_join(spark, sf_dir):
    d = load(spark, sf_dir, "documents").filter("source <> 'src0'").select("doc_id", "source")
    return load(spark, sf_dir, "labels").join(d, "doc_id").groupBy("source").agg(F.count("*").alias("pending"), F.sum("toxic").cast("long").alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"))


@query(f"""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS before FROM {EVENTS})
    SELECT event_id, user_id, ts_ms, before, c_name AS name FROM e LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0 WHERE event_type = 'purchase' AND (before IS NULL OR before <> 'purchase')""")
def activations_left_join(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id")))
    e = e.filter("event_type = 'purchase' AND (before IS NULL OR before <> 'purchase')")
    c = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return e.join(c, "user_id", "left").select("event_id", "user_id", "ts_ms", "before", "name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_mktsegment <> 'BUILDING'")
def unreferenced_anti(spark, sf_dir):
    c = load(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name")
    return c.join(load(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def semi_scope(spark, sf_dir):
    scope = load(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(scope, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH r AS (SELECT l_orderkey AS owner, l_partkey AS ref FROM lineitem), k AS (SELECT p_partkey FROM part WHERE p_size < 25)
    SELECT owner, n_refs, n_missing, CASE WHEN n_missing = 0 THEN 'none' WHEN n_missing = n_refs THEN 'all' ELSE 'some' END AS state
    FROM (SELECT owner, count(ref) AS n_refs, count(*) FILTER (p_partkey IS NULL) AS n_missing FROM r LEFT JOIN k ON ref = p_partkey GROUP BY 1)""")
def dangling_refs(spark, sf_dir):
    refs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("ref"))
    return R.reference_state(refs, load(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("ref")), "owner", "ref")


@query("SELECT p_partkey AS part, coalesce(n, 0) AS mentions FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def mention_recount(spark, sf_dir):
    return R.recount(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")), load(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("part")), "part")


@query(f"""SELECT p.event_id, p.user_id, p.ts_ms, (SELECT max_by(v.event_id, (v.ts_ms, v.event_id)) FROM {EVENTS} v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts_ms <= p.ts_ms) AS view_id
    FROM {EVENTS} p WHERE p.event_type = 'purchase'""")
def asof_heading(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts_ms", F.col("event_id").alias("view_id")).groupBy("user_id", "ts_ms").agg(F.max("view_id").alias("view_id"))
    return R.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts_ms"), views, ["user_id"], "ts_ms", "view_id")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS version, epoch_us(o_orderdate) // 1000 AS valid_from, lead(epoch_us(o_orderdate) // 1000) OVER w AS valid_to
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 1000, o_orderkey)""")
def scd2_close(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("valid_from"))
    return sinks.close_versions(o, ["o_custkey"], "valid_from", "o_orderkey")


@query("""WITH b AS (SELECT p_partkey, p_size AS v, p_retailprice AS price, 0 AS n FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size + 1, p_retailprice * 2, 1 FROM part WHERE p_partkey % 2 = 0)
    SELECT p_partkey, v, price FROM b QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC) = 1""")
def upsert_merge(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("v"), F.col("p_retailprice").alias("price"))
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("v") + 1).alias("v"), (F.col("price") * 2).alias("price"))
    return sinks.upsert(p.filter("p_partkey % 3 <> 0"), new, ["p_partkey"], "v")


@query("SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_orderkey % 4 < 2")
def insert_ignore(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    return sinks.insert_ignore(x.filter("o % 4 = 0").distinct(), x.filter("o % 4 < 2"), ["o", "s"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    gone = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.delete_where_key(load(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_update(spark, sf_dir):
    return sinks.partial_update(load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query("SELECT coalesce(source, 'ALL') AS source, coalesce(lang, 'ALL') AS lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def space_summary_rollup(spark, sf_dir):
    x = load(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return x.withColumns({"source": F.coalesce("source", F.lit("ALL")), "lang": F.coalesce("lang", F.lit("ALL"))})


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY p) AS pos FROM (SELECT unnest([5, 3, 99999999, 1, 7]) AS k, unnest([0, 1, 2, 3, 4]) AS p) JOIN orders ON k = o_orderkey""")
def order_preserving_fetch(spark, sf_dir):
    wanted = spark.createDataFrame([(k, p) for p, k in enumerate([5, 3, 99999999, 1, 7])], "o_orderkey long, p int")
    x = load(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(wanted), "o_orderkey")
    return x.select("o_orderkey", F.row_number().over(Window.orderBy("p")).alias("pos"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations QUALIFY pos <= 3")
def recent_turns(spark, sf_dir):
    return R.last_per_group(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)


@query("SELECT event_type, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def median_latency(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query("""SELECT l_orderkey AS trace, array_to_string(list_sort(list(DISTINCT l_shipmode)), ',') AS kinds FROM (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1""")
def kinds_by_trace(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("kinds"))


@query(f"SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'failed' ELSE event_type END AS status FROM {EVENTS}")
def interrupted_recovery(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"))
    return sinks.partial_update(e, F.col("status").isin("view", "click"), {"status": F.lit("failed")})


@query(f"""SELECT user_id, count(*) FILTER (event_type = 'view') AS waiting, count(*) FILTER (event_type = 'click') AS running, max_by(event_type, (ts_ms, event_id)) AS last_status FROM {EVENTS} GROUP BY 1""")
def ingest_depth(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("o", F.struct("ts_ms", "event_id"))
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("waiting"), F.count_if(F.col("event_type") == "click").alias("running"), F.max_by("event_type", "o").alias("last_status"))


@query(f"""WITH e AS (SELECT user_id, ts_ms, coalesce(ts_ms - lag(ts_ms) OVER w >= 21600000, true) AS new FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
    s AS (SELECT user_id, ts_ms, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts_ms) AS start_ms, max(ts_ms) + 21600000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("at", F.timestamp_millis("ts_ms"))
    x = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return x.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


@query(f"""SELECT w * 600000 AS start_ms, event_type, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures FROM
    (SELECT event_type, unnest([ts_ms // 600000, ts_ms // 600000 - 1, ts_ms // 600000 - 2]) AS w FROM {EVENTS}) GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'error') > 0""")
def alert_windows(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("at", F.timestamp_millis("ts_ms"))
    x = e.groupBy(F.window("at", "30 minutes", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures")).filter("failures > 0")
    return x.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "calls", "failures")
