"""Graph queries: customers and suppliers tied by nations, orders and parts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import knowledge_map as M
from ..operators import lifecycle as L
from ..sources.tables import load
from .base import EVENTS, query

EDGES = "(SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def _edges(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


@query(f"""WITH RECURSIVE b AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT 'o1' AS node, 0 AS depth UNION SELECT b.dst, depth + 1 FROM r JOIN b ON b.src = r.node WHERE depth < 2)
    SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def bfs_neighborhood(spark, sf_dir):
    return G.neighbourhood(_edges(spark, sf_dir), spark.createDataFrame([("o1",)], "node string"), 2)


@query(f"""WITH RECURSIVE b AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT 'o1' AS node, 0 AS depth UNION SELECT b.dst, depth + 1 FROM r JOIN b ON b.src = r.node WHERE depth < 2)
    SELECT src, dst FROM {EDGES} WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)""")
def induced_subgraph(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.induced_edges(e, G.neighbourhood(e, spark.createDataFrame([("o1",)], "node string"), 2)).select("src", "dst")


@query("""WITH n AS (SELECT 'n' || n_nationkey AS node FROM nation UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0),
    e AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS kind FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'from' FROM supplier)
    SELECT * FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)""")
def knowledge_map_edges(spark, sf_dir):
    n, r, s = (load(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), c)
    nodes = n.select(name("n", "n_nationkey").alias("node")).unionByName(r.select(name("r", "r_regionkey").alias("node"))).unionByName(s.filter("s_acctbal > 0").select(name("s", "s_suppkey").alias("node")))
    return G.typed_edges([("in", n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))), ("from", s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")))], nodes)


@query(f"""WITH t AS (SELECT ts_ms AS "at", 'u' || user_id AS label, 'signup' AS kind, 0 AS o FROM {EVENTS} WHERE event_type = 'signup' UNION ALL SELECT ts_ms, 'u' || user_id, 'purchase', 1 FROM {EVENTS} WHERE event_type = 'purchase')
    SELECT "at", label, kind FROM t ORDER BY "at" DESC, o DESC, label DESC LIMIT 200""")
def timeline(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("ts_ms").alias("at"), F.concat(F.lit("u"), "user_id").alias("label"), "event_type")
    return G.timeline([(k, e.filter(F.col("event_type") == k)) for k in ("signup", "purchase")], 200)


@query(f"""WITH b AS (SELECT event_type AS topic, ts_ms // 86400000 AS step, count(*) AS n, sum(k) AS s FROM {EVENTS} GROUP BY 1, 2)
    SELECT topic, step, CAST(sum(n) OVER w AS BIGINT) AS born, round(sum(s) OVER w / sum(n) OVER w, 6) AS mean_confidence FROM b WINDOW w AS (PARTITION BY topic ORDER BY step)""")
def timeline_replay(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("ts_ms").alias("at"), F.col("k").alias("confidence"))
    return G.replay(e, 86_400_000)


@query("SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_size < 20")
def coverage_gaps(spark, sf_dir):
    nodes = load(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").alias("node"))
    e = load(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst"))
    return G.unreferenced(nodes, e).withColumnRenamed("node", "part")


@query("""WITH r AS (SELECT l_orderkey AS id, unnest(list(DISTINCT 'p' || l_partkey)) AS ref FROM lineitem GROUP BY 1), g AS (SELECT 'p' || p_partkey AS ref FROM part WHERE p_size > 25)
    SELECT id, array_to_string(list_sort(list(r.ref)), ',') AS refs FROM r WHERE r.ref NOT IN (SELECT ref FROM g) GROUP BY 1""")
def prune_references(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("refs"))
    gone = load(spark, sf_dir, "part").filter("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("ref"))
    return L.prune_references(rows, gone, "refs", True).select("id", F.array_join(F.sort_array("refs"), ",").alias("refs"))


@query("""SELECT 'orphan_orders' AS finding, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    UNION ALL SELECT 'orphan_lines', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 1) UNION ALL SELECT 'unused_parts', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def doctor_report(spark, sf_dir):
    o, c, x, p = (load(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part"))
    missing = lambda a, b, left, right: a.join(b, a[left] == b[right], "left_anti").agg(F.count("*").alias("n"))
    parts = [("orphan_orders", missing(o, c.filter("c_acctbal >= 0"), "o_custkey", "c_custkey")), ("orphan_lines", missing(x, p.filter("p_size <> 1"), "l_partkey", "p_partkey")), ("unused_parts", missing(p, x, "p_partkey", "l_partkey"))]
    out = [d.select(F.lit(k).alias("finding"), "n") for k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


NAMES = "(SELECT term AS name FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS term FROM benchmark) WHERE length(term) >= 6 GROUP BY 1 HAVING count(*) >= 2)"
WORDS = NAMES.replace(">= 6", ">= 3")


def _names(spark, sf_dir, least=6):
    """Entities: terms of ``least`` letters and more that occur twice or more in the benchmark."""
    terms = load(spark, sf_dir, "benchmark").select(F.explode(T.latin_terms(F.col("text"))).alias("name"))
    return terms.filter(F.length("name") >= least).groupBy("name").count().filter("count >= 2").select("name")


@query(f"""WITH m AS (SELECT doc_id, name FROM documents, {NAMES} WHERE contains(lower(text), name))
    SELECT doc_id, name AS entity, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS place FROM m QUALIFY place <= 5""")
def entity_mentions(spark, sf_dir):
    """Entities that a text holds literally, the longest names first, five at most."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return G.mentions(docs, _names(spark, sf_dir), "doc_id", "t", 5)


@query(f"""WITH e AS (SELECT name AS id, lower(trim(name)) AS k FROM {WORDS}), raw AS (SELECT item_id, ' ' || upper(a) || ' ' AS src, b AS dst, 'near' AS predicate FROM
    (SELECT item_id, t[i] AS a, t[i + 1] AS b FROM (SELECT item_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS t FROM benchmark))))
    SELECT s.id AS src, d.id AS dst, predicate, min(item_id) AS first_item FROM raw JOIN e s ON lower(trim(src)) = s.k JOIN e d ON lower(trim(dst)) = d.k WHERE s.id <> d.id GROUP BY 1, 2, 3""")
def resolve_relations(spark, sf_dir):
    """Relations given by names, tied to entity ids without regard to case and outer space; self loops and repeats go."""
    t = load(spark, sf_dir, "benchmark").select("item_id", T.latin_terms(F.col("text")).alias("t"))
    at = t.select("item_id", "t", F.posexplode("t").alias("i", "a")).select("item_id", F.concat(F.lit(" "), F.upper("a"), F.lit(" ")).alias("src"), F.get("t", F.col("i") + 1).alias("dst")).filter("dst IS NOT NULL")
    raw = at.withColumn("predicate", F.lit("near"))
    entities = _names(spark, sf_dir, 3).select(F.col("name").alias("id"), "name")
    return G.resolve_endpoints(raw, entities).groupBy("src", "dst", "predicate").agg(F.min("item_id").alias("first_item"))


@query(f"""WITH n AS {NAMES}, e AS (SELECT DISTINCT name, doc_id FROM documents, n WHERE contains(lower(text), name)), q AS (SELECT item_id AS query_id, lower(text) AS q FROM benchmark),
    s AS (SELECT query_id, name FROM q, n WHERE contains(q, name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) <= 5),
    w AS (SELECT query_id, doc_id, count(*) AS weight FROM s JOIN e USING (name) GROUP BY 1, 2)
    SELECT query_id, doc_id, CAST(0.5 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, doc_id) AS rank FROM w QUALIFY rank <= 20""")
def graph_leg(spark, sf_dir):
    """Documents tied to entities that a question names, by the number of ties; a constant score."""
    names = _names(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    ties = G.mentions(docs, names, "doc_id", "t", None).select(F.col("entity").alias("name"), "doc_id")
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("t"))
    asked = G.mentions(q, names, "query_id", "t", 5).select("query_id", F.col("entity").alias("name"))
    found = asked.join(ties, "name").groupBy("query_id", "doc_id").agg(F.count("*").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "doc_id"))
    return found.withColumn("rank", rank).filter("rank <= 20").select("query_id", "doc_id", F.lit(0.5).alias("score"), "rank")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE lower(trim(c_name)) IN (SELECT lower(trim('  CUSTOMER#00000' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || ' ')) FROM nation)
    QUALIFY row_number() OVER (PARTITION BY lower(trim(c_name)) ORDER BY c_acctbal DESC, c_custkey) = 1""")
def find_by_name(spark, sf_dir):
    """The row of each name asked for, without regard to case and outer space; ties go to the larger balance, then the smaller id."""
    asked = load(spark, sf_dir, "nation").select(F.lower(F.trim(F.concat(F.lit("  CUSTOMER#00000"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit(" ")))).alias("k"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.lower(F.trim("c_name")).alias("k")).join(asked, "k", "left_semi")
    best = c.groupBy("k").agg(F.max_by(F.struct("c_custkey", "c_name", "c_acctbal"), F.struct("c_acctbal", -F.col("c_custkey"))).alias("r"))
    return best.select("r.*")


#: A map made of the tables: nations are topics, customers documents, parts cards, suppliers insights.
MAP = """c AS (SELECT p_partkey AS id, p_size / 40.0::DOUBLE AS confidence, list(DISTINCT o_custkey) FILTER (l_quantity > 45 AND o_custkey IS NOT NULL) AS documents FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
    t AS (SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'core' WHEN 1 THEN 'common' WHEN 2 THEN 'advanced' ELSE 'odd' END AS importance, [n_nationkey * 3 + 1, n_nationkey * 3 + 2, n_nationkey * 3 + 2, n_nationkey * 7 + 1000000] AS cards FROM nation WHERE n_nationkey % 5 > 0 UNION ALL SELECT -1, 'core', CAST([] AS BIGINT[])),
    d AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'ready' END AS status FROM customer WHERE c_custkey % 3 > 0),
    i AS (SELECT s_suppkey AS id, s_acctbal / 5000.0::DOUBLE AS confidence, [s_suppkey, s_suppkey * 2, s_suppkey] AS cards FROM supplier),
    w AS (SELECT * FROM c ORDER BY confidence DESC, id LIMIT 120),
    h AS (SELECT DISTINCT t.id AS topic, c.id FROM (SELECT id, unnest(cards) AS card FROM t) t JOIN c ON c.id = t.card),
    p AS (SELECT d.id, count(*) AS produced FROM (SELECT id AS card, unnest(documents) AS doc FROM c) x JOIN d ON d.id = x.doc GROUP BY 1)"""


def _map(spark, sf_dir):
    part, line, orders, nation, customer, supplier = (load(spark, sf_dir, t) for t in ("part", "lineitem", "orders", "nation", "customer", "supplier"))
    of = line.filter("l_quantity > 45").join(orders, line["l_orderkey"] == orders["o_orderkey"]).groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set("o_custkey").alias("documents"))
    cards = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 40).alias("confidence")).join(of, "id", "left")
    key = F.col("n_nationkey").cast("long")
    importance = F.when(F.col("n_regionkey") == 0, "core").when(F.col("n_regionkey") == 1, "common").when(F.col("n_regionkey") == 2, "advanced").otherwise("odd")
    topics = nation.filter("n_nationkey % 5 > 0").select(key.alias("id"), importance.alias("importance"), F.array(key * 3 + 1, key * 3 + 2, key * 3 + 2, key * 7 + 1000000).alias("cards"))
    topics = topics.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("core").alias("importance"), F.array().cast("array<bigint>").alias("cards")))
    documents = customer.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("ready").alias("status"))
    s = F.col("s_suppkey")
    insights = supplier.select(s.alias("id"), (F.col("s_acctbal") / 5000).alias("confidence"), F.array(s, s * 2, s).alias("cards"))
    return M.knowledge_map(topics, documents, cards, insights, 120)


@query(f"""WITH {MAP}, tm AS (SELECT t.id, importance, CASE WHEN count(h.id) > 0 THEN round(least(1.0, count(h.id) / 3.0::DOUBLE) * avg(greatest(0.0, least(1.0, confidence))), 3) END AS m FROM t LEFT JOIN h ON h.topic = t.id LEFT JOIN c ON c.id = h.id GROUP BY 1, 2),
    tn AS (SELECT 'topic:' || id AS id, 'topic' AS kind, CASE importance WHEN 'core' THEN 1.0 WHEN 'common' THEN 0.7 WHEN 'advanced' THEN 0.5 ELSE 0.6 END::DOUBLE AS weight, coalesce(m, 0.0)::DOUBLE AS mastery, CASE WHEN m IS NULL THEN 'uncovered' ELSE 'covered' END AS status FROM tm)
    SELECT * FROM tn UNION ALL SELECT 'domain', 'domain', 1.0, round(avg(mastery), 3), NULL FROM tn
    UNION ALL SELECT 'document:' || d.id, 'document', round(greatest(0.2::DOUBLE, coalesce(produced, 0) / (SELECT max(produced) FROM p)), 3), NULL, status FROM d LEFT JOIN p USING (id)
    UNION ALL SELECT 'card:' || id, 'card', round(greatest(0.0, least(1.0, confidence)), 3), round(greatest(0.0, least(1.0, confidence)), 3), NULL FROM w
    UNION ALL SELECT 'insight:' || id, 'insight', round(greatest(0.0, least(1.0, confidence)), 3), round(greatest(0.0, least(1.0, confidence)), 3), NULL FROM i""")
def knowledge_map_nodes(spark, sf_dir):
    """Nodes of the map with their weights, and how well topics are known."""
    return _map(spark, sf_dir)[0]


@query(f"""WITH {MAP}, cv AS (SELECT topic, id FROM h WHERE id IN (SELECT id FROM w)), sr AS (SELECT DISTINCT doc, id FROM (SELECT id, unnest(documents) AS doc FROM w) WHERE doc IN (SELECT id FROM d)),
    ls AS (SELECT DISTINCT card, id FROM (SELECT id, unnest(cards) AS card FROM i) WHERE card IN (SELECT id FROM w))
    SELECT 'domain' AS src, 'topic:' || id AS dst, 'topic' AS kind FROM t UNION ALL SELECT 'domain', 'document:' || id, 'source' FROM d
    UNION ALL SELECT 'topic:' || topic, 'card:' || id, 'covers' FROM cv UNION ALL SELECT 'document:' || doc, 'card:' || id, 'source' FROM sr
    UNION ALL SELECT 'domain', 'card:' || id, 'covers' FROM w WHERE id NOT IN (SELECT id FROM cv) AND id NOT IN (SELECT id FROM sr)
    UNION ALL SELECT 'card:' || card, 'insight:' || id, 'insight' FROM ls UNION ALL SELECT 'domain', 'insight:' || id, 'insight' FROM i WHERE id NOT IN (SELECT id FROM ls)""")
def knowledge_map_links(spark, sf_dir):
    """What ties the nodes: topics and sources to the domain, cards to both or to the domain, insights to their cards or to the domain."""
    return _map(spark, sf_dir)[1]
