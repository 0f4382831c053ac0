"""Items in the JSON of model texts: whole, fenced, inside prose, and broken off."""

from pyspark.sql import functions as F

from ..operators import salvage
from ..sources.tables import load
from .base import query

#: A text for each order: its lines as cards, written in one of four ways by the order's key; the last is broken off after three fifths.
ITEM = r"""'{"kind": ' || CASE l_linenumber % 5 WHEN 1 THEN '"Concept"' WHEN 2 THEN '" 注意事项 "' WHEN 3 THEN '"other"' WHEN 4 THEN 'null' ELSE '"tool"' END || ', "title": "Part ' || l_partkey || '", "body": "a [b] {c} \"d\" \\ ' || l_suppkey || '", "confidence": ' ||
    CASE l_partkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '"0.25"' WHEN 2 THEN 'true' ELSE '-1' END || ', "aliases": ' || CASE l_suppkey % 3 WHEN 0 THEN '[" x ", "", "y"]' WHEN 1 THEN '"z"' ELSE 'null' END || '}'"""
TEXTS = f"""(SELECT *, CASE l_orderkey % 4 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Cards: ' || body || ' That is all.' ELSE substr(body, 1, length(body) * 3 // 5) END AS text
    FROM (SELECT l_orderkey, '{{"note": "[not] {{a list}}", "cards": [' || string_agg(item, ', ' ORDER BY l_linenumber, item) || '], "more": []}}' AS body FROM (SELECT l_orderkey, l_linenumber, {ITEM} AS item FROM lineitem) GROUP BY 1))"""


def _texts(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(ITEM.replace(r"\"d\" \\ '", r"\\\"d\\\" \\\\ '")).alias("item"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "item")))
    body = F.concat(F.lit('{"note": "[not] {a list}", "cards": ['), F.array_join(F.transform(lines, lambda i: i["item"]), ", "), F.lit('], "more": []}'))
    t = x.groupBy("l_orderkey").agg(body.alias("body"))
    way = F.col("l_orderkey") % 4
    text = F.when(way == 0, F.col("body")).when(way == 1, F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).when(way == 2, F.concat(F.lit("Cards: "), "body", F.lit(" That is all.")))
    return t.select("l_orderkey", text.otherwise(F.expr("substr(body, 1, length(body) * 3 div 5)")).alias("text"))


CARDS = f"""(SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 3 THEN 'salvaged' ELSE 'parsed' END AS how, CAST(row_number() OVER w - 1 AS INTEGER) AS pos,
    CASE l_linenumber % 5 WHEN 1 THEN 'concept' WHEN 2 THEN 'pitfall' WHEN 3 THEN 'other' WHEN 4 THEN NULL ELSE 'tool' END AS kind, 'Part ' || l_partkey AS title, 'a [b] {{c}} "d" ' || chr(92) || ' ' || l_suppkey AS body,
    CASE l_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0.0 END AS confidence, CASE l_suppkey % 3 WHEN 0 THEN 'x,y' WHEN 1 THEN 'z' ELSE '' END AS aliases, l_linenumber % 5 IN (0, 1, 2) AS ok
    FROM (SELECT l.*, sum(length(item) + 2) OVER (PARTITION BY l.l_orderkey ORDER BY l_linenumber, item ROWS UNBOUNDED PRECEDING) - 2 + length('{{"note": "[not] {{a list}}", "cards": [') AS upto, length(t.text) AS most
          FROM (SELECT *, {ITEM} AS item FROM lineitem) l JOIN {TEXTS} t USING (l_orderkey)) WHERE l_orderkey % 4 <> 3 OR upto <= most WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, item))"""


def _cards(spark, sf_dir):
    found = salvage.items(_texts(spark, sf_dir), ["l_orderkey"], "text", ["cards", "more"], json=False)
    return salvage.cards(found, ["l_orderkey"])


@query(f"SELECT * FROM {CARDS}")
def salvaged_cards(spark, sf_dir):
    """Cards in model texts, checked one by one; of texts broken off, those that are closed."""
    c = _cards(spark, sf_dir)
    return c.select("l_orderkey", "how", "pos", "kind", "title", "body", "confidence", F.array_join("aliases", ",").alias("aliases"), "ok")


@query(f"SELECT how, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS skipped FROM {CARDS} GROUP BY 1")
def extraction_skips(spark, sf_dir):
    """Cards taken and skipped; a bad one costs no other."""
    return _cards(spark, sf_dir).groupBy("how").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("skipped"))
