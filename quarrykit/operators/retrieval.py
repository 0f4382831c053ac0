"""Retrieval: inverted index, BM25, exact k-NN, fusion, floors, sibling merge, and the greedy steps on one query's candidates."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stats import dot
from ..functions.text import latin_terms
from ..sources.stage import staged
from .groups import along_groups
from .nearest import nearest

RRF_K = 60
DEDUP, LAMBDA = 0.85, 0.7
#: Candidates of a query that go into the greedy steps.
POOL = 50
#: Bytes of a query table up to which it is sent to all tasks; a larger one is joined in blocks.
QUERY_ROWS = 10_000
#: Different terms up to which bm25() filters words inside the row by a literal set; numbers of a block of scores.
LITERAL_TERMS, DENSE = 10_000, 1 << 21
#: Rows of (query, term) up to which bm25() sends them to all tasks.
SENT_TERMS = 500_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): dl is the document's number of terms."""
    terms = docs.select(key, latin_terms(F.col(text)).alias("__t")).withColumn("dl", F.size("__t"))
    return terms.select(key, "dl", F.explode("__t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each row of queries(query_id, query) by Okapi BM25.

    One pass over the texts leaves each document's number of words and those words that a query has, looked up by Arrow; all else works on these. Each task
    scores its documents for all queries at once and keeps k of each, so postings of common terms never meet queries in a shuffle. Beyond LITERAL_TERMS
    different terms, the terms are joined instead (see _bm25_joined).
    """
    terms = staged(queries.select("query_id", F.explode(F.array_distinct(latin_terms(F.col("query")))).alias("term")))
    different = terms.select("term").distinct()
    if different.count() > LITERAL_TERMS or queries.count() > QUERY_ROWS:
        return _bm25_joined(docs, key, text, terms, k, k1, b)
    asked = terms.toArrow()  # no more rows than LITERAL_TERMS times QUERY_ROWS; in truth those of the queries
    names = sorted(set(asked["term"].to_pylist()))
    if not names:
        return docs.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double, rank int")
    held = staged(docs.select(key, F.lower(F.col(text)).alias("t")).mapInArrow(_asked_words(names, key), f"{key} {docs.schema[key].dataType.simpleString()}, dl int, t array<int>"))
    n, avgdl = held.agg(F.count("*"), F.avg("dl")).first()
    df = {names[r["term"]]: r["df"] for r in held.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the queries
    place = {t: i for i, t in enumerate(names)}
    ids = asked["query_id"].unique()
    of = {q: i for i, q in enumerate(ids.to_pylist())}
    matrix = np.zeros((len(names), len(of)))
    for q, t in zip(asked["query_id"].to_pylist(), asked["term"].to_pylist()):
        matrix[place[t], of[q]] = math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double"
    sent = docs.sparkSession.sparkContext.broadcast((matrix, ids))

    def run(batches):
        matrix, ids = sent.value
        best: list[list[tuple[float, object]]] = [[] for _ in range(matrix.shape[1])]
        rows = max(1, DENSE // max(matrix.shape))
        for batch in batches:
            keys, length, lists = batch.column(0).to_pylist(), batch.column(1).fill_null(0).to_numpy(), batch.column(2)
            for s in range(0, len(keys), rows):
                part = lists.slice(s, rows)
                cell = pc.list_parent_indices(part).to_numpy() * len(matrix) + pc.list_flatten(part).to_numpy()
                tf = np.bincount(cell, minlength=len(part) * len(matrix)).reshape(len(part), len(matrix)).astype(np.float64)
                norm = k1 * (1 - b + b * length[s : s + rows] / (avgdl or 1.0))
                exact = (tf * (k1 + 1) / (tf + norm[:, None])) @ matrix
                scores = np.round(exact, 6)
                for q in range(scores.shape[1]):
                    own = best[q]
                    least = -own[-1][0] if len(own) == k else -1.0
                    for i in np.flatnonzero((scores[:, q] >= least) & (exact[:, q] > 0)).tolist():
                        own.append((-scores[i, q], keys[s + i]))
                    own.sort()
                    del own[k:]
        flat = [(ids[q], x, -score) for q, own in enumerate(best) for score, x in own]
        columns = [[x[0].as_py() for x in flat], [x[1] for x in flat], [x[2] for x in flat]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], names=["query_id", key, "score"])

    kind = to_arrow_type(docs.schema[key].dataType)
    return ranked(held.mapInArrow(run, kinds), ["query_id"], [F.desc("score"), F.asc(key)], k)


def _asked_words(names: list[str], key: str):
    """(key, dl, t) of rows (key, lower text): the number of words and, as places in names, those words that are among them. Texts are cut and looked up by Arrow."""

    def run(batches):
        table = pa.array(names, pa.string())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cut = pc.split_pattern_regex(part.column(1), "[^0-9a-z]+")
                words, of = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
                length = np.bincount(of[pc.not_equal(words, "").to_numpy(zero_copy_only=False)], minlength=part.num_rows)
                at = pc.index_in(words, table)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.bincount(of[hit], minlength=part.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), at.drop_null())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int32(), mask=part.column(1).is_null().to_numpy(zero_copy_only=False)), lists], names=[key, "dl", "t"])

    return run


def _bm25_joined(docs, key, text, terms, k, k1, b) -> DataFrame:
    """bm25() for terms by the million: words that no query has go before anything is shuffled, and each document leaves one row, with an empty term, for the
    statistics of all documents. Terms go to every task while they are no more than SENT_TERMS; beyond, they are joined by a shuffle."""
    sent = F.broadcast if terms.count() <= SENT_TERMS else lambda df: df
    wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    words = docs.select(key, latin_terms(F.col(text)).alias("__t")).select(key, F.size("__t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("__t", F.array().cast("array<string>")))).alias("term"))
    hits = staged(words.join(sent(wanted), "term").groupBy("term", key, "dl").agg(F.count("*").alias("tf")))
    n, avgdl = hits.filter("term = ''").agg(F.count("*"), F.avg("dl")).first()
    hits = hits.filter("term <> ''")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the queries
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
    scored = hits.join(sent(df), "term").withColumn("part", part).join(sent(terms), "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.asc(key)], k)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def pooled(df: DataFrame, order: list[Column], most: int = POOL) -> DataFrame:
    """The first ``most`` candidates of each query: what the greedy steps on one query's candidates take, so that a group is bounded."""
    return ranked(df, ["query_id"], order, most).drop("rank")


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k nearest of vectors to each row of queries(query_id, query), by 1 / (1 + squared distance) (see nearest.py)."""
    return nearest(vectors, queries, key, vector, k)


def unit_cosine(a: Column, b: Column) -> Column:
    return dot(a, b)


def rrf(legs: DataFrame, id_: str, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf, first, legs) of legs(query_id, leg_ord, leg, rank, id, weight): sums of weight / (k + rank); an id counts once in a leg, and ties keep what comes first."""
    once = legs.groupBy("query_id", "leg_ord", "leg", id_).agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    out = once.groupBy("query_id", id_).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("leg_ord", "rank")).alias("first"), F.sort_array(F.collect_set("leg")).alias("legs"))
    return out.withColumn("rrf", F.round("rrf", 9))


def relevance_floor(df: DataFrame, score: str, floor: float = 0.1, confident: float = 0.5) -> DataFrame:
    """Per query, rows of at least floor times the top score; nothing is dropped if there is one row, a score is null or outside 0..1, or the top is below confident."""
    w = Window.partitionBy("query_id")
    s = F.col(score)
    odd = F.max(F.when(s.isNull() | (s < 0) | (s > 1), 1).otherwise(0)).over(w)
    top = F.max(s).over(w)
    skip = (F.count("*").over(w) <= 1) | (odd == 1) | (top < confident)
    return df.withColumn("__keep", skip | (s >= top * floor)).filter("__keep").drop("__keep")


def near_top(df: DataFrame, score: str, gap: float = 0.1) -> DataFrame:
    return df.withColumn("__top", F.max(score).over(Window.partitionBy("query_id"))).filter(F.col(score) >= F.col("__top") - gap).drop("__top")


def sibling_merge(df: DataFrame, least: int = 2) -> DataFrame:
    """Neighbours of evidence(query_id, pos, id, kind, doc, heading, ordinal, start, end, content, score) become one row: bodies of the same document and heading whose
    ordinals and spans join and whose contents are just their spans (parts of a table with a copied header are not), ``least`` of them or more. The row has the best
    place, the id of the best score (of ties the first), the first ordinal, the contents and ids (merged) in order; other rows stay, with merged empty."""
    w = Window.partitionBy("query_id", "doc", "__h").orderBy("ordinal", "pos")
    good = F.coalesce((F.col("kind") == "body") & (F.col("end") - F.col("start") == F.length("content")) & F.col("ordinal").isNotNull(), F.lit(False))
    run = df.withColumn("__h", F.coalesce("heading", F.lit(""))).withColumn("__good", good)
    joins = F.col("__good") & F.lag("__good").over(w) & (F.lag("ordinal").over(w) + 1 == F.col("ordinal")) & (F.lag("end").over(w) == F.col("start"))
    run = run.withColumn("__run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    size = F.count("*").over(Window.partitionBy("query_id", "doc", "__h", "__run"))
    run = run.withColumn("__size", size).withColumn("__one", F.when(F.col("__size") < least, F.col("pos")))
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("ordinal")))
    out = run.groupBy("query_id", "doc", "__h", "__run", "__one").agg(
        F.min("pos").alias("pos"), best.alias("__b"), F.first("id").alias("__id"), F.max("__size").alias("__n"), F.first("kind").alias("kind"), F.first("heading").alias("heading"), F.first("score").alias("__score"),
        F.min("ordinal").alias("ordinal"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("ordinal", "pos", "id", "content"))).alias("__r"),
    )
    many = F.col("__n") >= least
    return out.select(
        "query_id", "pos", F.when(many, F.col("__b.id")).otherwise(F.col("__id")).alias("id"), "kind", "doc", "heading", "ordinal", "start", "end", F.array_join(F.transform("__r", lambda x: x["content"]), "").alias("content"),
        F.when(many, F.col("__b.score")).otherwise(F.col("__score")).alias("score"), F.when(many, F.transform("__r", lambda x: x["id"])).otherwise(F.expr("filter(transform(__r, x -> x.id), x -> false)")).alias("merged"),
    )


def _grams(text: str) -> set[str]:
    x = " ".join(text.split()).casefold()
    return {x[i : i + 4] for i in range(len(x) - 3)} if len(x) >= 4 else {x}


def _alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / min(len(a), len(b))


def suppressed(rows: list[dict], threshold: float = DEDUP, keep_min: int = 1) -> list[dict]:
    """Rows in order that are not alike by more than threshold to a row kept before; the first keep_min stay."""
    kept, sets = [], []
    for row in rows:
        g = _grams(row["content"] or "")
        if len(kept) < keep_min or not any(_alike(g, s) > threshold for s in sets):
            kept.append(row)
            sets.append(g)
    return kept


def diversified(rows: list[dict], weight: float = LAMBDA, limit: int | None = None) -> list[dict]:
    """Rows, best first, picked one by one by weight * relevance - (1 - weight) * likeness to what is picked; relevance comes from ranks alone."""
    raw = [1 / (r + 2) for r in range(len(rows))]
    span = (raw[0] - raw[-1]) if rows else 0.0
    relevance = [(x - raw[-1]) / span if span else 1.0 for x in raw]
    sets = [_grams(r["content"] or "") for r in rows]
    left, out, nearest = list(range(len(rows))), [], [0.0] * len(rows)
    while left and (limit is None or len(out) < limit):
        best = max(left, key=lambda i: (weight * relevance[i] - (1 - weight) * nearest[i], -i))
        out.append(rows[best])
        left.remove(best)
        for i in left:
            nearest[i] = max(nearest[i], _alike(sets[i], sets[best]))
    return out


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def suppress_redundant(df: DataFrame, threshold: float = DEDUP, keep_min: int = 1) -> DataFrame:
    """suppressed() for each query's candidates, by pos; these are a bounded pool."""
    return along_groups(df, ["query_id"], ["pos"], lambda rows: suppressed(rows, threshold, keep_min), _columns(df))


def mmr(df: DataFrame, score: str, weight: float = LAMBDA, limit: int = 8) -> DataFrame:
    """diversified() for each query's candidates, by score; pos is the new place, from 1."""
    step = lambda rows: [r | {"pos": i} for i, r in enumerate(diversified(rows, weight, limit), 1)]
    return along_groups(df, ["query_id"], [F.desc(score), F.asc("pos")], step, _columns(df))
