"""Recall, detail joins and context assembly of a knowledge base."""

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import ranked


def stale(df: DataFrame, status: str, ready: str, version: str, current: int) -> DataFrame:
    """Rows that are not ready or of another version; null counts as either."""
    return df.filter(~F.coalesce((F.col(status) == ready) & (F.col(version) == current), F.lit(False)))


def in_order(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The values of each group as an array in the order given. A group is what one message or card has, which is small."""
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v")))).alias("__r"))
    return rows.select(*by, F.transform("__r", lambda x: x["__v"]).alias(out))


def lineage(left: DataFrame, key: str, links: str, right: DataFrame, link: str, items: str) -> DataFrame:
    """(key, link, item): left's array of links tied to right's rows of those links and their array of items."""
    a = left.select(key, F.explode(links).alias(link))
    return a.join(right.select(link, F.explode(items).alias("item")), link)


def drop_followed(rows: DataFrame, runs: DataFrame, at: str, within: int) -> DataFrame:
    """Rows that no run follows within so many units of time. A run lies in the bucket of its row or the next one, so the join is on buckets."""
    first = runs.select(F.col(at).alias("__run")).distinct().withColumn("__b", F.floor(F.col("__run") / within))
    both = first.select("__run", F.explode(F.array(F.col("__b"), F.col("__b") - 1)).alias("__b"))
    keyed = rows.withColumn("__b", F.floor(F.col(at) / within))
    gap = both["__run"] - keyed[at]
    return keyed.join(both, (keyed["__b"] == both["__b"]) & (gap >= 0) & (gap <= within), "left_anti").drop("__b")


def enrich(rows: DataFrame, key: str, items: str, titles: DataFrame, on: str) -> DataFrame:
    """rows whose array of structs gets the columns of titles; order stays, and items without a match stay unchanged."""
    flat = rows.select(key, F.posexplode_outer(items).alias("__pos", "__item")).withColumn(on, F.col(f"__item.{on}"))
    more = [c for c in titles.columns if c != on]
    joined = flat.join(titles, on, "left").withColumn("__item", F.struct(F.col("__item.*"), *more))
    back = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__pos", "__item"))).alias("__r"))
    return back.select(key, F.transform("__r", lambda x: x["__item"]).alias(items))


def recall(hits: DataFrame, key: str, least_score: float, least_confidence: float, limit: int) -> DataFrame:
    """Of hits(query_id, key, score, status, confidence) those that are active, near and sure enough; ``limit`` of each query."""
    good = (F.col("status") == "active") & (F.col("score") >= least_score) & (F.col("confidence") >= least_confidence)
    return ranked(hits.filter(good), ["query_id"], [F.desc("score"), F.asc(key)], limit)


def recall_or_fall_back(queries: DataFrame, hits: DataFrame, items: DataFrame, key: str, index_empty: bool, limit: int, least_score: float = 0.45, least_confidence: float = 0.5, generic: list[str] = (), widen: int = 4) -> DataFrame:
    """(query_id, key, rank, origin) of at most ``limit`` active items of enough confidence for each of queries(query_id, terms, has_vector).

    A query with hits(query_id, key, score) takes those that are near enough, and none if none is: they are not made up for. A query without a vector, or while the
    index is empty one without hits, takes those of the ``widen`` * limit surest items that share a term with it which is not generic. items are (key, terms, status,
    confidence); the surest are few and go to every task.
    """
    good = items.filter((F.col("status") == "active") & (F.col("confidence") >= least_confidence))
    near = hits.join(queries.filter("has_vector").select("query_id"), "query_id", "left_semi")
    by_vector = near.filter(F.col("score") >= least_score).join(good.select(key), key, "left_semi")
    first = ranked(by_vector.select("query_id", key, "score"), ["query_id"], [F.desc("score"), F.asc(key)], limit).select("query_id", key, "rank", F.lit("vector").alias("origin"))
    rest = queries.join(near.select("query_id").distinct(), "query_id", "left_anti") if index_empty else queries.filter("NOT has_vector")
    sure = good.orderBy(F.desc("confidence"), key).limit(limit * widen).select(key, "confidence", F.explode(F.array_distinct("terms")).alias("term"))
    asked = rest.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    asked = asked.filter(~F.col("term").isin(*generic)) if generic else asked
    shared = asked.join(F.broadcast(sure), "term").select("query_id", key, "confidence").distinct()
    second = ranked(shared, ["query_id"], [F.desc("confidence"), F.asc(key)], limit).select("query_id", key, "rank", F.lit("terms").alias("origin"))
    return first.unionByName(second)


def normalized_items(df: DataFrame, kinds: dict[str, str], otherwise: str, default: float = 0.5) -> DataFrame:
    """Items with their kind by synonyms, confidence within 0..1 and aliases, a scalar, as a list."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in kinds.items()))
    return df.withColumns({
        "kind": F.coalesce(F.try_element_at(table, F.lower(F.trim("kind"))), F.lit(otherwise)),
        "confidence": F.when(F.col("confidence").isNull(), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))),
        "aliases": F.array_compact(F.array("aliases")),
    })


def known_markers(marks: Column, known: Column) -> Column:
    """Markers that are known, each once, in the order of their first place."""
    return F.array_distinct(F.filter(marks, lambda x: F.array_contains(known, x)))


def with_summaries(chunks: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """chunks(key, ordinal, kind, start, end, content) and, with the ordinal after the last, one row for each of summaries(key, content)."""
    n = chunks.groupBy(key).agg((F.max("ordinal") + 1).alias("ordinal"))
    own = summaries.join(n, key, "left").select(key, F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.lit("summary").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), "content")
    return chunks.unionByName(own)


def verdicts(items: DataFrame, key: str) -> DataFrame:
    """(key, items, paired, verdict) from items(key, a, b), the scores of both arms: promote or archive where at least half of the items are paired and the mean
    difference is two standard errors or more from 0."""
    d = F.col("a") - F.col("b")
    sums = items.groupBy(key).agg(F.count("*").alias("items"), F.count(d).alias("paired"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"))
    few = (F.col("paired") < F.greatest(F.lit(1), F.floor(F.col("items") / 2))) | (F.col("paired") < 2) | (F.coalesce("sd", F.lit(0.0)) == 0)
    verdict = F.when(few, "skipped").when(F.abs("delta") < 2 * F.col("sd") / F.sqrt("paired"), "undecided").when(F.col("delta") > 0, "promote").otherwise("archive")
    return sums.select(key, "items", "paired", verdict.alias("verdict"))
