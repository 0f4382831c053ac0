"""A search from its legs to its evidence: fusion, near copies, scores, diversity, overlaps, siblings, and what it had to do without."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as X
from .context import without_overlaps
from .groups import along_groups

#: Candidates of a query that are looked up and scored; how many times the limit goes into the steps that may merge or drop rows.
POOL, WIDER = 50, 2


def fused(legs: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, id, rrf, pos, legs) of legs(query_id, leg, rank, id) in order: ranks fused, with the legs that found each. A leg may be empty."""
    rows = None
    for i, (name, leg) in enumerate(legs):
        one = leg.select("query_id", F.lit(i).alias("leg_ord"), F.lit(name).alias("leg"), "rank", "id", F.lit(1.0).alias("weight"))
        rows = one if rows is None else rows.unionByName(one)
    out = X.rrf(rows, "id")
    return X.ranked(out, ["query_id"], [F.desc("rrf"), F.col("first"), F.asc("id")]).withColumnRenamed("rank", "pos").drop("first")


def retrieve(hits: DataFrame, evidence: DataFrame, score: Callable[[DataFrame], DataFrame] | None, limit: int, diversity: bool = True, merge: bool = True, pool: int = POOL) -> DataFrame:
    """The evidence of each query, ``limit`` rows, with pos from 1, the legs that found it, and reranked.

    hits are fused(); of each query ``pool`` are looked up in evidence(id, kind, doc, heading, ordinal, start, end, content) (ids that are gone go). Near copies go
    first, as they would go later anyhow, so that score, which adds the column rerank, is not asked for them. Where a query has a score for any candidate, those with
    one come first by score and the others go; else the fused order stands. Then near copies, diversity and overlaps of neighbours, and siblings that join again.
    """
    found = evidence.join(hits.filter(F.col("pos") <= pool).select("query_id", "id", "rrf", "pos", "legs"), "id")
    columns = X._columns(found)
    if diversity:
        found = along_groups(found, ["query_id"], ["pos"], X.suppressed, columns)
    found = score(found) if score else found.withColumn("rerank", F.lit(None).cast("double"))
    by = Window.partitionBy("query_id")
    found = found.withColumn("reranked", F.max(F.col("rerank").isNotNull()).over(by)).filter(~F.col("reranked") | F.col("rerank").isNotNull())
    found = found.withColumn("pos", F.row_number().over(by.orderBy(F.desc_nulls_last("rerank"), "pos"))).filter(F.col("pos") <= limit * WIDER)
    found = found.withColumn("score", F.coalesce("rerank", "rrf")).drop("rerank", "rrf")
    most = limit * WIDER if merge else limit

    def step(rows):
        if len(rows) > 1:
            rows = without_overlaps(X.diversified(X.suppressed(rows), limit=most) if diversity else rows)
        return [r | {"pos": i} for i, r in enumerate(rows, 1)]

    ordered = along_groups(found, ["query_id"], ["pos"], step, X._columns(found))
    if not merge:
        return ordered.filter(F.col("pos") <= limit).withColumn("merged", F.expr("filter(array(id), x -> false)"))
    tags = ordered.select("query_id", "id", "legs", "reranked")
    joined = X.sibling_merge(ordered).join(tags, ["query_id", "id"])
    return joined.withColumn("pos", F.row_number().over(by.orderBy("pos"))).filter(F.col("pos") <= limit)


def degraded(queries: DataFrame, hits: DataFrame, legs: list[str], results: DataFrame) -> DataFrame:
    """(query_id, <leg>_empty, rerank_fallback) of every query: legs without a hit, and whether the order is not that of scores."""
    seen = hits.groupBy("query_id").agg(*(F.max(F.array_contains("legs", leg)).alias(leg) for leg in legs))
    scored = results.groupBy("query_id").agg(F.max("reranked").alias("reranked"))
    out = queries.join(seen, "query_id", "left").join(scored, "query_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return out.select("query_id", *(no(leg).alias(f"{leg}_empty") for leg in legs), no("reranked").alias("rerank_fallback"))
