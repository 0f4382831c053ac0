"""Document fingerprints: bottom-k sketches of hashed five-word shingles.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (lower case, words as in common.words; a shorter
text is one shingle, a text without words has none). Sketches merge: the k smallest of the union of two sketches are the sketch of the
union. They estimate resemblance, containment and the number of distinct shingles, exactly where a set has at most k. All of it is
DataFrame functions.

Cases: null text counts as empty, with the empty sketch; two empty sketches are alike (1), an empty and another are not (0). In the order of
op3, rows without doc_id come last and rows of one doc_id stand in descending order of text; a single row is its own next. An empty table
gives no rows; columns beyond doc_id and text are ignored.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, words
from .quality import window_hashes

K = 256
SHINGLE = 5
#: Rows that a range of neighbours in op3 aims at, and ranges at most.
RANGE_ROWS, MAX_RANGES = 5_000, 65_536


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Add the column out: the sketch of the string column text."""
    h = F.col("__h")
    df = df.withColumn("__h", F.transform(words(F.lower(F.col(text))), lambda x: F.xxhash64(x)))
    few = F.array_compact(F.array(F.when(F.size(h) > 0, F.xxhash64(h))))
    df = df.withColumn("__g", F.when(F.size(h) < size, few).otherwise(window_hashes(h, size)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct("__g")), 1, k)).drop("__h", "__g")


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of each group's union: distinct hashes, of which each task keeps a group's k smallest before the shuffle."""
    values = df.select(*keys, F.explode(sketch).alias("__v")).distinct()
    least = values.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__v"))).filter(F.col("__r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the sets behind two sketches."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that b's holds: resemblance * |union| / |a|; 0 for an empty a."""
    union = distinct_shingles(F.slice(F.sort_array(F.array_union(a, b)), 1, k), k)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits a hash; bigger values in the same order as the sketch."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _range_of(key: Column, splits: list[int]) -> Column:
    """The number of splits up to key, found in two steps so that no row is held against all of them."""
    if not splits:
        return F.lit(0)
    m = math.isqrt(len(splits) - 1) + 1
    parts = [splits[i : i + m] for i in range(0, len(splits), m)]
    lit = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    part = F.size(F.filter(lit([p[0] for p in parts]), lambda s: s <= key))
    within = F.size(F.filter(F.element_at(F.array(*(lit(p) for p in parts)), F.greatest(part, F.lit(1))), lambda s: s <= key))
    return F.when(part == 0, 0).otherwise((part - 1) * m + within)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add next_<column>, for each carried column, of the row that follows in descending order of doc_id; the last is followed by the first.

    Rows are dealt into ranges of doc_id. Each range also gets the first row of the range below (the lowest gets the highest's), so that a
    window over one range sees all neighbours; texts are shuffled once and no window spans the table.
    """
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    splits = []
    if ranges > 1:
        at = docs.agg(F.percentile_approx("__key", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges)).alias("s")).first()["s"]
        splits = sorted(set(at))
    docs = docs.withColumn("__range", _range_of(F.col("__key"), splits))
    tops = sorted((r["__range"], r["top"]) for r in docs.groupBy("__range").agg(F.max("__key").alias("top")).collect())
    above = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)] if tops else []
    firsts = docs.sparkSession.createDataFrame(above, "__key long, __above int")
    docs = docs.join(F.broadcast(firsts), "__key", "left")
    places = F.when(F.col("__above").isNotNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("__above").alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest"))))
    docs = docs.withColumn("__p", F.explode(places)).withColumn("__r", F.col("__p.r")).withColumn("__guest", F.col("__p.guest"))
    order = Window.partitionBy("__r").orderBy("__guest", F.desc("__key"), F.desc("text"))
    return docs.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter("__guest = 0").drop("__key", "__range", "__above", "__p", "__r", "__guest")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: its sketch, that of its edited text (the last third replaced from the next document), and what they say of each other."""
    docs = with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch", k)
    docs = with_next(docs, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    docs = with_sketch(docs.withColumn("edited", edited), "edited", "edited_sketch", k)
    a = F.col("sketch")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(a, F.col("edited_sketch"), k).alias("near_edited"), resemblance(a, F.col("next_sketch"), k).alias("near_next"), distinct_shingles(a, k).alias("est_shingles"), containment(a, F.col("edited_sketch"), k).alias("in_edited"),
    )


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
