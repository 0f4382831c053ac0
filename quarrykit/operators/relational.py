"""Filters, pages, latest rows, joins and rollups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal_like(column: Column, part: str) -> Column:
    """Whether column contains part, upper and lower case alike; no character of part is a wildcard."""
    return F.lower(column).contains(part.lower())


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """The page of limit rows that follow the cursor in the order of keys (name, descending); the last key must be unique."""
    if after is not None:
        if len(after) != len(keys):
            raise ValueError("the cursor does not fit the keys")
        beyond = F.lit(False)
        for i, (name, down) in enumerate(keys):
            own = F.col(name) < F.lit(after[i]) if down else F.col(name) > F.lit(after[i])
            for j in range(i):
                own &= F.col(keys[j][0]) == F.lit(after[j])
            beyond |= own
        df = df.filter(beyond)
    return df.orderBy(*(F.col(k).desc() if down else F.col(k).asc() for k, down in keys)).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order; summed before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__x"))
    return newest.select(*keys, "__x.*")


def last_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group, with their distance from the end in pos (1 is the last)."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).filter(F.col("pos") <= n)


def top_with_pinned(df: DataFrame, order: list[Column], key: str, pinned: list, limit: int) -> DataFrame:
    """The first limit rows in order; pinned keys are kept, in place of the last ones if need be."""
    first = df.withColumn("__p", F.col(key).isin(pinned))
    return first.orderBy(F.desc("__p"), *order).limit(limit).drop("__p")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, carry: str) -> DataFrame:
    """left with the column carry of the last row of right whose ``at`` is not later, by key; a union and one window, no range join."""
    r = right.select(*keys, F.col(at).alias(at), F.col(carry).alias("__c"), F.lit(0).alias("__side"))
    own = left.columns
    both = left.withColumn("__side", F.lit(1)).withColumn("__c", F.lit(None).cast(right.schema[carry].dataType)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(carry, F.last("__c", ignorenulls=True).over(w)).filter("__side = 1").select(*own, carry)


def reference_state(refs: DataFrame, known: DataFrame, owner: str, ref: str) -> DataFrame:
    """Per owner: how many references it has, how many are missing from known, and whether none, some or all are."""
    k = known.select(F.col(ref)).distinct().withColumn("__known", F.lit(1))
    out = refs.join(k, ref, "left").groupBy(owner).agg(F.count(ref).alias("n_refs"), F.count_if(F.col(ref).isNotNull() & F.col("__known").isNull()).alias("n_missing"))
    state = F.when(F.col("n_refs") == 0, "empty").when(F.col("n_missing") == 0, "none").when(F.col("n_missing") == F.col("n_refs"), "all").otherwise("some")
    return out.withColumn("state", state)


def recount(entities: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """entities with the column mentions counted anew; 0 where there is none."""
    counts = mentions.groupBy(key).agg(F.count("*").alias("mentions"))
    return entities.join(counts, key, "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def usage_rollup(usage: DataFrame, key: str) -> DataFrame:
    """Calls, tokens, mean latency and cache hit rate of usage(key, prompt, completion, cached, latency)."""
    out = usage.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cached").alias("cached"), F.round(F.avg("latency"), 6).alias("avg_latency")
    )
    rate = F.when(F.col("prompt") > 0, F.least(F.col("cached") / F.col("prompt"), F.lit(1.0))).otherwise(0.0)
    return out.withColumns({"total": F.col("prompt") + F.col("completion"), "hit_rate": F.round(rate, 6)})


def failure_alerts(calls: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """Per key with a failure: failures, calls, the last of either kind and whether a success came after the last failure."""
    out = calls.groupBy(key).agg(F.count_if(failed).alias("failures"), F.count("*").alias("calls"), F.max(F.when(failed, F.col(at))).alias("last_failed"), F.max(F.when(~failed, F.col(at))).alias("last_ok"))
    return out.filter("failures > 0").withColumn("recovered", F.coalesce(F.col("last_ok") > F.col("last_failed"), F.lit(False)))
