"""Quality rules: per-document counts, and lines that too many documents of one host share.

A line is normalised (lower case, runs of white space and digits as one space) and hashed; the distinct documents of each (host, line) are
counted. Lines above the limit of their host are removed, and a document of which too little is left is rejected. Documents are told apart by
doc_id (rows without one by their content), or, where ``by_text`` is asked for, by their text, so that copies do not condemn each other before a
later step drops them. All of it is DataFrame functions.

Cases: null text counts as empty and fails the base rules; a null source is a host of its own; rows that repeat a document get equal
verdicts; an empty table gives no rows; columns beyond doc_id, text and source are ignored by quality() and kept by keep_good(), which gives the
texts without the removed lines and brings n_chars, where there is one, in line with them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, few, joined, materialize, table, word_count, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"


def window_hashes(h: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` elements of the array of longs h; empty where it is shorter."""
    return F.when(F.size(h) >= size, F.transform(F.slice(h, 1, F.size(h) - (size - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, size))))).otherwise(F.expr("array()").cast("array<bigint>"))


def base_metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, row_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines) of each row."""
    space = " \t\n\x0b\x0c\r"
    text = F.col("t")
    out = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumn("w", words(text)).withColumn("ln", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    out = out.select(
        "doc_id",
        F.xxhash64(F.coalesce("host", F.lit("\0none"))).alias("host"),
        F.xxhash64("t").alias("text_hash"),
        F.xxhash64("doc_id", "host", "t", F.length("t")).alias("row_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", space, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.transform("ln", lambda x: F.struct(F.xxhash64(F.lower(F.regexp_replace(F.trim(x), SPACE[:-1] + "0-9]+", " "))).alias("line"), word_count(x).cast("int").alias("words"))).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    out = out.withColumn("g", window_hashes(F.col("h"), WINDOW))
    # only texts that repeat a window are sorted: equal hashes then stand side by side
    s, g = F.col("s"), F.col("g")
    out = out.withColumn("s", F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    same = lambda x, i, j: F.coalesce(F.get(s, i + j)["h"] == x["h"], F.lit(False))
    out = out.withColumn("p", F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"])))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.select("doc_id", "host", "text_hash", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines")


def _judged(docs: DataFrame, least_docs: int = 20, max_share: float = 0.05, min_words: int = 10, min_left: float = 0.2, by_text: bool = False) -> DataFrame:
    """The counts of base_metrics() with words_left and kept.

    A line is over its host's limit where more than least_docs distinct documents of the host, and more than max_share of them, have it. A
    document is depleted where fewer than min_words words, or less than min_left of its words, are left. ``gone`` has the places of the lines
    over the limit among the document's lines with words, in ascending order; null where there are none.
    """
    rows = materialize(base_metrics(docs))
    document = F.col("text_hash") if by_text else F.when(F.col("doc_id").isNull(), F.col("row_hash")).otherwise(F.xxhash64("doc_id"))
    lines = rows.select("host", document.alias("document"), F.explode("lines.line").alias("line"))
    lines = lines.groupBy("host", "line", "document").agg(F.count("*").alias("times"))
    counts = materialize(lines.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.sum("times").alias("times")).filter(F.col("n_docs") > least_docs))
    hosts = few(rows.select("host", document.alias("document")).distinct().groupBy("host").agg(F.count("*").alias("host_docs")))
    over = counts.join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line", "times", F.lit(True).alias("over"))
    total = rows.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    # what is removed is summed by position, so that rows that repeat a document don't add up
    hit = rows.select("host", "row_hash", F.posexplode("lines").alias("pos", "x")).select("host", "row_hash", "pos", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    hit = joined(hit, over, ["host", "line"], total, "inner")
    removed = hit.groupBy("row_hash", "pos").agg(F.max("words").alias("words")).groupBy("row_hash").agg(F.sum("words").alias("removed"), F.sort_array(F.collect_list("pos")).alias("gone"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    out = rows.drop("lines").join(removed, "row_hash", "left").withColumn("words_left", left)
    good = (F.col("words_left") >= min_words) & (F.col("words_left") >= min_left * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & good).alias("kept"), "words_left", "row_hash", "gone")


def quality(docs: DataFrame, **limits) -> DataFrame:
    """The counts and verdict of each row; the limits are those of _judged()."""
    return _judged(docs, **limits).drop("gone")


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the ascending places ``gone`` among its lines with words; all other lines stay as they are."""
    lines = F.split(text, "\n", -1)
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    cut = F.transform(gone, lambda p: F.get(at, p))
    ends = F.concat(cut, F.array(F.size(lines)))
    # runs of lines between those that go
    runs = F.transform(F.concat(F.array(F.lit(-1)), cut), lambda c, k: F.slice(lines, c + 2, F.get(ends, k) - c - 1))
    return F.array_join(F.flatten(runs), "\n")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, their texts without the lines over the limit."""
    verdict = _judged(docs, **limits).filter("kept").groupBy(F.col("row_hash").alias("key")).agg(F.first("gone").alias("gone"))
    own = F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))))
    kept = docs.select(own.alias("key"), F.struct("*").alias("whole")).join(verdict, "key")
    cut = F.col("gone").isNotNull()
    kept = kept.select("whole", "gone", F.when(cut, without_lines(F.col("whole.text"), F.col("gone"))).otherwise(F.col("whole.text")).alias("clean"))
    made = {"text": F.col("clean"), "n_chars": F.when(cut, F.length("clean").cast("long")).otherwise(F.col("whole.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*(made[c].alias(c) if c in made else F.col(f"whole.`{c}`").alias(c) for c in docs.columns))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("row_hash")
