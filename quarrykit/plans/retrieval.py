"""Search over documents and embeddings. Every text of the benchmark is a question; query vectors are all whose id is divisible by 100."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, graph, scores, search
from ..operators import retrieval as X
from ..operators.nearest import nearest
from ..sources.stage import staged
from ..sources.tables import load
from .base import query

BM25 = """q AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[0-9a-z]+')) AS term FROM q),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
KNN = """vq AS (SELECT vec_id // 100 AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), vs AS (SELECT query_id, vec_id, round(1 / (1 + list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS score FROM embeddings, vq),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vs)"""


def _bm25(spark, sf_dir, k):
    return X.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k)


def _knn(spark, sf_dir, k):
    e = load(spark, sf_dir, "embeddings")
    return X.knn(e, e.filter("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 100).alias("query_id"), F.col("embedding").alias("query")), "vec_id", "embedding", k)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@query("""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS term FROM documents) GROUP BY 1""")
def inverted_index(spark, sf_dir):
    return X.postings(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {KNN} SELECT query_id, vec_id, score, rank FROM vr WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir, 10)


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id,
    round(list_sum(list_transform(list_zip(v, q), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x))), 6) AS cosine
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q)
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 5""")
def knn_cosine(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return nearest(e, q, "vec_id", "embedding", 5, "cosine").select("query_id", "vec_id", F.col("score").alias("cosine"))


def _legs(spark, sf_dir, k=50):
    """Both legs over ids of documents; vector i stands for document i."""
    bm = _bm25(spark, sf_dir, k).select("query_id", F.lit(1).alias("leg_ord"), F.lit("fts").alias("leg"), "rank", F.col("doc_id").alias("id"), F.lit(1.0).alias("weight"), "score")
    vec = _knn(spark, sf_dir, k).select("query_id", F.lit(0).alias("leg_ord"), F.lit("vec").alias("leg"), "rank", F.col("vec_id").alias("id"), F.lit(1.0).alias("weight"), "score")
    return vec.unionByName(bm)


FUSED = f"""{BM25}, {KNN}, legs AS (SELECT query_id, 0 AS leg_ord, 'vec' AS leg, rank, vec_id AS id FROM vr WHERE rank <= 50 UNION ALL SELECT query_id, 1, 'fts', rank, doc_id FROM bmr WHERE rank <= 50),
    f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(leg_ord * 1000 + rank) AS first, list_sort(list(DISTINCT leg)) AS legs FROM legs GROUP BY 1, 2),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, id) AS pos FROM f)"""


@query(f"WITH {FUSED} SELECT query_id, id, rrf, array_to_string(legs, ',') AS legs, pos FROM fr WHERE pos <= 20")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).filter("pos <= 20").select("query_id", "id", "rrf", F.array_join("legs", ",").alias("legs"), "pos")


def _fused(spark, sf_dir):
    f = X.rrf(_legs(spark, sf_dir), "id")
    return X.ranked(f, ["query_id"], [F.desc("rrf"), F.col("first"), F.asc("id")]).withColumnRenamed("rank", "pos")


@query(f"""WITH {FUSED}, pool AS (SELECT fr.query_id, fr.id, rrf, pos, source, length(text) AS n FROM fr JOIN documents ON id = doc_id WHERE pos <= 50)
    SELECT query_id, id, rrf, pos, source, n AS content_length FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 8""")
def hybrid_search(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.length("text").cast("long").alias("content_length"))
    pool = _fused(spark, sf_dir).filter("pos <= 50").select("query_id", "id", "rrf", "pos")
    hits = d.join(pool, "id")
    return X.ranked(hits, ["query_id"], [F.asc("pos")], 8).select("query_id", "id", "rrf", "pos", "source", "content_length")


@query(f"WITH {KNN}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM vr WHERE rank <= 50) SELECT query_id, vec_id, score, rank FROM t WHERE score >= top - 0.5")
def near_top_gap(spark, sf_dir):
    return X.near_top(_knn(spark, sf_dir, 50), "score", 0.5)


@query("""WITH s AS (SELECT source AS query_id, labels.doc_id, (quality * 7 + toxic * 2 + labels.doc_id % 10) / 20.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
    w AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, count(*) OVER (PARTITION BY query_id) AS n FROM s)
    SELECT query_id, doc_id, score FROM w WHERE n <= 1 OR top < 0.5 OR score >= top * 0.5""")
def relevance_floor(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query_id"))
    s = load(spark, sf_dir, "labels").join(d, "doc_id").select("query_id", "doc_id", ((F.col("quality") * 7 + F.col("toxic") * 2 + F.col("doc_id") % 10) / 20.0).alias("score"))
    return X.relevance_floor(s, "score", 0.5, 0.5)


def _evidence(spark, sf_dir):
    """The turns of conversations as neighbouring chunks: each starts where the one before ends, but after every fourth turn; some are summaries, some begin with a
    copied header."""
    c = load(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(
        F.col("conv_id").alias("query_id"), ((F.col("turn") * 7 + 3) % 11).alias("pos"), F.col("turn").alias("id"), F.when(F.col("turn") % 6 == 5, "summary").otherwise("body").alias("kind"),
        F.col("conv_id").alias("doc"), F.when(F.col("conv_id") % 2 == 0, "h").alias("heading"), F.col("turn").alias("ordinal"),
        (end - F.col("n") + F.when(F.col("turn") % 4 == 0, 1).otherwise(0)).cast("long").alias("start"), end.cast("long").alias("end"),
        F.concat(F.when(F.col("turn") % 7 == 3, "| h |").otherwise(""), F.substring("text", F.when(F.col("turn") % 4 == 0, 2).otherwise(1), F.length("text"))).alias("content"), (F.col("n") % 13 / 13.0).alias("score"),
    )


@query("""WITH c AS (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
    v AS (SELECT conv_id, (turn * 7 + 3) % 11 AS pos, turn, e - n + CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END AS s, e, CASE WHEN turn % 7 = 3 THEN '| h |' ELSE '' END || CASE WHEN turn % 4 = 0 THEN substr(text, 2) ELSE text END AS text,
          n % 13 / 13.0::DOUBLE AS score, turn % 6 <> 5 AND turn % 7 <> 3 AS good FROM c),
    b AS (SELECT *, CASE WHEN good AND lag(good) OVER w AND lag(turn) OVER w + 1 = turn AND lag(e) OVER w = s THEN 0 ELSE 1 END AS brk FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM b)
    SELECT conv_id AS query_id, min(pos) AS pos, CAST(arg_max(turn, score * 1000 - turn * 0.001) AS INTEGER) AS id, min(turn) AS ordinal, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", round(max(score), 6) AS score,
        CASE WHEN count(*) > 1 THEN string_agg(turn, ',' ORDER BY turn) ELSE '' END AS merged, sha256(string_agg(text, '' ORDER BY turn)) AS content FROM r GROUP BY conv_id, run""")
def sibling_merge(spark, sf_dir):
    m = X.sibling_merge(_evidence(spark, sf_dir))
    return m.select("query_id", "pos", "id", "ordinal", "start", "end", F.round("score", 6).alias("score"), F.array_join(F.transform("merged", lambda x: x.cast("string")), ",").alias("merged"), F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@query()
def mmr_rerank(spark, sf_dir):
    return X.mmr(X.pooled(_evidence(spark, sf_dir), [F.desc("score"), F.asc("pos"), F.asc("ordinal")]), "score")


@query()
def overlap_trim(spark, sf_dir):
    return context.trim_overlap(_evidence(spark, sf_dir).select("query_id", "pos", "doc", "ordinal", "start", "end", "content"))


@query()
def budget_allocate(spark, sf_dir):
    e = _evidence(spark, sf_dir).select("query_id", "pos", "ordinal", T.estimate_tokens(F.col("content")).alias("demand"))
    return context.allocate(e, 60, 15)


@query("""WITH c AS (SELECT conv_id AS query_id, turn AS ordinal, length(text) AS n FROM conversations WHERE turn % 5 <> 4), s AS (SELECT conv_id AS query_id, max(turn) AS last FROM conversations GROUP BY 1),
    k AS (SELECT query_id, count(DISTINCT ordinal) AS have, sum(n) AS chars FROM c GROUP BY 1)
    SELECT s.query_id, last FROM s LEFT JOIN k USING (query_id) WHERE NOT (coalesce(have, 0) = last + 1 AND chars <= 4000)""")
def covered_summary_drop(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ordinal"), F.length("text").alias("n"))
    summaries = c.groupBy("query_id").agg(F.max("ordinal").alias("last"))
    have = c.filter("ordinal % 5 <> 4").groupBy("query_id").agg(F.countDistinct("ordinal").alias("have"), F.sum("n").alias("chars"))
    covered = summaries.join(have, "query_id").filter("have = last + 1 AND chars <= 4000")
    return summaries.join(covered.select("query_id"), "query_id", "left_anti").select("query_id", "last")


@query("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+')) AS t FROM benchmark)
    SELECT a.item_id, len(list_intersect(a.t, q.t)) > 0 AS shares FROM b a, (SELECT t FROM b WHERE item_id = (SELECT min(item_id) FROM b)) q""")
def lexical_gate(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select("item_id", T.latin_terms(F.col("text")).alias("t"))
    first = b.groupBy().agg(F.min_by("t", "item_id").alias("q"))
    return b.join(F.broadcast(first)).select("item_id", F.arrays_overlap("t", "q").alias("shares"))


def _chunk_search(spark, sf_dir):
    """Chunks of documents, the legs of each question over them, and a stand-in for a model's scores, which every third question has none of."""
    chunks = staged(chunking.chunk_documents(load(spark, sf_dir, "documents"), "doc_id", "text", target=200, overlap=40).withColumn("id", F.col("doc_id") * 1000 + F.col("ordinal")))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    fts = X.bm25(chunks, "id", "content", asked, 50).select("query_id", F.lit("fts").alias("leg"), "rank", "id")
    names = asked.select(F.explode(T.latin_terms(F.col("query"))).alias("name")).filter(F.length("name") >= 6).groupBy("name").count().filter("count >= 2").select("name")
    ties = graph.mentions(chunks.select("id", F.lower("content").alias("t")), names, "id", "t").select(F.col("entity").alias("name"), "id")
    named = graph.mentions(asked.select("query_id", F.lower("query").alias("t")), names, "query_id", "t", 5).select("query_id", F.col("entity").alias("name"))
    weight = named.join(ties, "name").groupBy("query_id", "id").agg(F.count("*").alias("w"))
    near = X.ranked(weight, ["query_id"], [F.desc("w"), F.asc("id")], 50).select("query_id", F.lit("graph").alias("leg"), "rank", "id")
    evidence = chunks.select("id", F.lit("body").alias("kind"), F.col("doc_id").alias("doc"), F.col("heading_path").alias("heading"), "ordinal", F.col("char_start").cast("long").alias("start"), F.col("char_end").cast("long").alias("end"), "content")
    score = F.when(F.col("query_id") % 3 > 0, (F.length("content") * 7 + F.col("query_id")) % 101 / F.lit(101.0))
    # written, as what follows would run both legs for each use; its size then tells that it can be sent to all tasks, and the chunks need no shuffle
    return staged(search.fused([("fts", fts), ("graph", near)])), evidence, lambda c: c.withColumn("rerank", score), asked


@query()
def retrieve(spark, sf_dir):
    """The whole search: two legs over chunks, fused, near copies out before scores are asked for, then diversity, overlaps, siblings, and the legs that found what stays."""
    fused, evidence, score, _ = _chunk_search(spark, sf_dir)
    out = search.retrieve(fused, evidence, score, limit=8)
    return out.select("query_id", "pos", "id", "doc", "ordinal", "start", "end", F.sha2(F.col("content").cast("binary"), 256).alias("content"), F.array_join("legs", ",").alias("legs"), "reranked", F.size("merged").alias("merged"))


@query(f"""WITH {BM25}, n AS (SELECT term AS name FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS term FROM benchmark) WHERE length(term) >= 6 GROUP BY 1 HAVING count(*) >= 2),
    g AS (SELECT DISTINCT item_id AS query_id FROM benchmark, n WHERE contains(lower(text), name)), f AS (SELECT DISTINCT query_id FROM bm)
    SELECT item_id AS query_id, item_id NOT IN (SELECT query_id FROM f) AS fts_empty, item_id NOT IN (SELECT query_id FROM g) AS graph_empty, item_id % 3 = 0 AS rerank_fallback FROM benchmark""")
def degraded_flags(spark, sf_dir):
    """What a question's search had to do without: a leg that found nothing, scores that were not to be had."""
    fused, evidence, score, asked = _chunk_search(spark, sf_dir)
    return search.degraded(asked.select("query_id"), fused, ["fts", "graph"], search.retrieve(fused, evidence, score, limit=8))
