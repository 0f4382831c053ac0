"""Chunks and pages of documents, of chats as markdown tables, and what must hold of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources.tables import load
from .base import query

BLANK = r"[ \t\n\r]"


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(load(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"SELECT doc_id, length(regexp_replace(text, '{BLANK}', '', 'g')) AS covered, true AS fits, true AS in_order FROM documents WHERE regexp_matches(text, '[^ \t\n\r]')")
def chunk_coverage(spark, sf_dir):
    """Characters that a document's chunks hold, those of overlaps once; whether all chunks keep to the target and come in order. None of the text may be missing."""
    c = chunk_documents(spark, sf_dir)
    by = Window.partitionBy("doc_id").orderBy("ordinal")
    c = c.withColumns({"before": F.coalesce(F.max("char_end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "last": F.lag("char_start", 1, -1).over(by)})
    new = F.substring("content", F.length("content") - (F.col("char_end") - F.greatest("char_start", "before")) + 1, F.length("content"))
    return c.groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace(new, BLANK, ""))).alias("covered"),
        F.bool_and(F.col("token_count") <= chunking.TARGET).alias("fits"),
        F.bool_and((F.col("char_end") > F.col("before")) & (F.col("char_start") >= F.col("last"))).alias("in_order"),
    )


def _chats(spark, sf_dir):
    """Each conversation as markdown: a heading, a table with a row for each turn, and the first turn as fenced code with bars and blank lines in it."""
    c = load(spark, sf_dir, "conversations").withColumn("line", F.concat(F.lit("| "), "turn", F.lit(" | "), "role", F.lit(" | "), F.regexp_replace("text", "\n", " "), F.lit(" |")))
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line", "text"))).alias("t"))
    head = F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n```\n| not | a row |\n\n# no heading\n```\n\n| turn | role | text |\n| ---: | :--- | --- |\n"))
    return one.select("conv_id", F.concat(head, F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.lit("\n\n## End\n\n"), F.col("t")[0]["text"]).alias("text"))


@query("SELECT conv_id, turn, true AS under_header FROM conversations")
def chunk_tables(spark, sf_dir):
    """Rows of tables by the chunks that hold them: each in one, and under the table's header wherever the table was cut."""
    c = chunking.chunk_documents(_chats(spark, sf_dir), "conv_id", "text", target=160, overlap=0)
    rows = c.select("conv_id", F.contains("content", F.lit("| turn | role | text |\n| ---: | :--- | --- |\n")).alias("under_header"), F.explode(F.split("content", "\n")).alias("line"))
    return rows.select("conv_id", F.regexp_extract("line", r"^\| (\d+) \| \w+ \|", 1).try_cast("int").alias("turn"), "under_header").filter("turn IS NOT NULL")


@query("""SELECT conv_id, CAST(1 AS BIGINT) AS chunks, 'Conversation ' || conv_id AS heading_path FROM conversations GROUP BY conv_id""")
def chunk_fences(spark, sf_dir):
    """Chunks that hold the fenced block whole, and the heading over it; marks inside the fence are no headings, rows or ends."""
    c = chunking.chunk_documents(_chats(spark, sf_dir), "conv_id", "text", target=160, overlap=0).filter(F.contains("content", F.lit("```\n| not | a row |\n\n# no heading\n```")))
    return c.groupBy("conv_id", "heading_path").agg(F.count("*").alias("chunks"))


MARK = chunking.PAGE_MARK


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents) WHERE text <> '' AND NOT contains(text, chr(13))),
    p AS (SELECT doc_id, i AS page, l[i] AS content, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS char_start FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM l))
    SELECT doc_id, CAST(page AS INTEGER) AS page, char_start, CAST(char_start + length(content) AS INTEGER) AS char_end, content FROM p WHERE content <> ''""")
def page_rows(spark, sf_dir):
    """Lines of documents as pages: marks between them are taken out, and the offsets are those in the text without them."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.btrim("text", F.lit(" \t\n\r")).alias("text")).filter("text <> '' AND NOT contains(text, '\r')")
    return chunking.page_rows(d.withColumn("text", F.replace("text", F.lit("\n"), F.lit(MARK))), "doc_id", "text")
