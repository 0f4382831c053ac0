"""Scores of (query, document) pairs that are computed once and kept as a table, and an order of candidates that does without them where there are none."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["scorer", "query_digest", "doc_digest"]
#: Columns of the table: score, and the last round in which a pair was asked for.
SCHEMA = "scorer string, query_digest string, doc_digest string, score double, used long"


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keyed(pairs: DataFrame, scorer: str) -> DataFrame:
    """pairs(query, text, ...) with the key of their scores: texts count, not the ids that they stand under."""
    return pairs.withColumns({"scorer": F.lit(scorer), "query_digest": digest(F.col("query")), "doc_digest": digest(F.col("text"))})


def missing(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row (key, query, text) for each pair of keyed pairs that cache(SCHEMA) has no score for."""
    return pairs.join(cache.filter("score IS NOT NULL").select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.first("query").alias("query"), F.first("text").alias("text"))


def refreshed(cache: DataFrame, pairs: DataFrame, score: Callable[[DataFrame], DataFrame] | Column, round_: int, most: int | None = None) -> DataFrame:
    """cache with the scores of all pairs of this round. Only missing ones are computed: score is an expression over query and text, or a function that adds the
    column score to rows of these. Pairs that could not be scored (null) are not kept. With ``most``, the rows used last stay, those of a round by their key."""
    new = missing(pairs, cache)
    new = (new.withColumn("score", score) if isinstance(score, Column) else score(new)).filter("score IS NOT NULL").select(*KEY, F.col("score").cast("double").alias("score"))
    asked = pairs.select(*KEY).distinct().withColumn("asked", F.lit(True))
    old = cache.join(asked, KEY, "left").select(*KEY, "score", F.when(F.col("asked"), F.lit(round_)).otherwise(F.col("used")).cast("long").alias("used"))
    out = old.unionByName(new.withColumn("used", F.lit(round_).cast("long")))
    return out if most is None else out.orderBy(F.desc("used"), *KEY).limit(most)


def reranked(candidates: DataFrame, cache: DataFrame, by: list[str], fallback: list[Column], limit: int) -> DataFrame:
    """Keyed candidates with their score, origin and rank. Where a query has a score for any of its candidates, those with one come first by score and the others go;
    where it has none, the fallback order stands, and origin says so."""
    c = candidates.join(cache.select(*KEY, "score"), KEY, "left")
    any_ = F.max(F.col("score").isNotNull()).over(Window.partitionBy(*by))
    c = c.withColumn("origin", F.when(any_, "score").otherwise("fallback")).filter((F.col("origin") == "fallback") | F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("score"), *fallback))
    return c.withColumn("rank", rank).filter(F.col("rank") <= limit).drop(*KEY)
