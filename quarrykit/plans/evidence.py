"""What goes into the context of an answer: cards, lessons and evidence within their budgets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sentences import estimate
from ..operators import evidence as E
from ..operators.groups import along_groups
from ..sources.tables import load
from .base import query
from .texts import GRAMS, NORM

#: Cards: each turn, and the same words once more in capitals with something after them.
CARDS = "(SELECT conv_id, turn * 2 + j AS pos, CASE j WHEN 0 THEN text ELSE translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' And more.' END AS text FROM conversations, (SELECT unnest([0, 1]) AS j))"


def _cards(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return c.select("conv_id", (F.col("turn") * 2 + F.col("j")).alias("pos"), F.when(F.col("j") == 0, F.col("text")).otherwise(F.concat(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" And more."))).alias("text"))


def _fold(items: str, keys: str, order: str, budget: str, opening: int) -> str:
    """SQL that goes along the items(keys, order, g, chars, wide) of each group and keeps what is new and fits."""
    more = "a.chars + x.chars + CASE WHEN len(a.kept) > 0 THEN 2 ELSE 0 END"
    known = f"len(x.seen) > 0 AND len(list_intersect(x.seen, a.seen)) / len(x.seen) >= CAST({E.COVERED} AS DOUBLE)"
    tokens = lambda c, w: f"{w} + ceil(({c} - ({w})) / 4.0)"
    return f"""(SELECT {keys}, list_reduce(list({{'seen': g, 'chars': CAST(chars AS BIGINT), 'wide': CAST(wide AS BIGINT), 'kept': [CAST({order} AS BIGINT)]}} ORDER BY {order}),
        lambda a, x: CASE WHEN ({known}) OR {tokens(more, "a.wide + x.wide")} > {budget} THEN a
            ELSE {{'seen': list_distinct(list_concat(a.seen, x.seen)), 'chars': {more}, 'wide': a.wide + x.wide, 'kept': list_concat(a.kept, x.kept)}} END,
        {{'seen': CAST([] AS VARCHAR[]), 'chars': CAST({opening} AS BIGINT), 'wide': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}}) AS a FROM {items} GROUP BY {keys})"""


TOKENS = "CAST(CASE WHEN len(a.kept) > 0 THEN a.wide + ceil((a.chars - a.wide) / 4.0) ELSE 0 END AS INTEGER)"
SIZED = rf"(SELECT conv_id, pos, {GRAMS} AS g, length(text) AS chars, len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) AS wide FROM (SELECT *, {NORM} AS t FROM {CARDS}))"


@query(f"SELECT conv_id, CAST(unnest(a.kept) AS INTEGER) AS pos FROM {_fold(SIZED, 'conv_id', 'pos', '1000000000', 0)}")
def seen_before(spark, sf_dir):
    """Cards that are rendered: one that rendered cards before it cover to 90 % goes, and doesn't count as seen itself."""
    return E.chosen(_cards(spark, sf_dir), ["conv_id"], "pos", "text", None).select("conv_id", "pos")


@query(f"SELECT conv_id, array_to_string(a.kept, ',') AS kept, {TOKENS} AS tokens FROM {_fold(SIZED, 'conv_id', 'pos', '200', 40)} WHERE len(a.kept) > 0")
def render_cards(spark, sf_dir):
    """Cards within a budget: one that doesn't fit is left out, and shorter ones after it may still come."""
    out = E.chosen(_cards(spark, sf_dir), ["conv_id"], "pos", "text", 200, opening="-" * 40)
    kept = F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",")
    return out.groupBy("conv_id").agg(kept.alias("kept"), F.max("tokens").alias("tokens"))


PARTS = "(SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS part, CAST([] AS VARCHAR[]) AS g, length(text) AS chars, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS wide FROM conversations)"


@query(f"""WITH k AS ({" UNION ALL ".join(f"SELECT conv_id, {p} AS part, a FROM {_fold(f'(SELECT * FROM {PARTS} WHERE part = {p})', 'conv_id', 'turn', str(b), 0)}" for p, b in ((0, 120), (1, 240), (2, 480)))})
    SELECT conv_id, CAST(turn AS INTEGER) AS turn, part, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS place FROM (SELECT conv_id, part, {TOKENS} AS tokens, unnest(a.kept) AS turn FROM k)""")
def context_assembly(spark, sf_dir):
    """The parts of a context in order, each within its own budget: a row that doesn't fit is left out, rows after it may come."""
    part = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"), "text")
    kept = None
    for p, budget in ((0, 120), (1, 240), (2, 480)):
        one = E.chosen(c.filter(F.col("part") == p), ["conv_id"], "turn", "text", budget, covered=None).withColumn("part", F.lit(p))
        kept = one if kept is None else kept.unionByName(one)
    by = Window.partitionBy("conv_id")
    kept = kept.withColumn("tokens", F.max("tokens").over(Window.partitionBy("conv_id", "part")))
    return kept.withColumn("place", F.row_number().over(by.orderBy("part", "turn")))


TRIM = 40


@query(rf"SELECT conv_id, turn, tokens <= {TRIM} AS whole, true AS fits, true AS of_text FROM (SELECT conv_id, turn, n + ceil((length(text) - n) / 4.0) AS tokens FROM (SELECT *, len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) AS n FROM conversations))")
def trim_to_budget(spark, sf_dir):
    """Turns within a budget: those that fit stay whole, all others keep to it, and what stays is of the text's beginning and end."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")

    def step(rows):
        out = []
        for r in rows:
            t = E.trimmed(r["text"], TRIM)
            head, _, tail = t.partition(E.MARK)
            out.append({"conv_id": r["conv_id"], "turn": r["turn"], "whole": t == r["text"], "fits": estimate(t) <= TRIM, "of_text": r["text"].startswith(head) and r["text"].endswith(tail)})
        return out

    return along_groups(c, ["conv_id"], ["turn"], step, "conv_id long, turn int, whole boolean, fits boolean, of_text boolean")


@query()
def compact_evidence(spark, sf_dir):
    """Documents cut to the windows that a question's terms lie in; the question is the benchmark's item of the document's turn."""
    q = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    n = q.count()
    d = load(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("item_id")).join(q, "item_id")
    return E.compact(d, "text", "question").select("doc_id", "item_id", "compacted", F.length("compacted").alias("n_chars"), (F.col("compacted") != F.col("text")).alias("changed"))


@query()
def render_evidence(spark, sf_dir):
    """The evidence of each conversation's context: its turns, best first by turn, each with a marker and a label."""
    c = load(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn") + 1).alias("marker"), F.concat(F.lit("Conversation "), "conv_id").alias("source"), F.col("text").alias("content"), F.lit("").alias("question"))
    return E.render_evidence(rows, ["conv_id"], "turn", budget=300, least=40)
