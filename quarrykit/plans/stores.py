"""Secrets in nested rows, kept scores, resumable stages."""

from pyspark.sql import functions as F

from ..functions import redact
from ..operators import scores, stages
from ..sources.stage import shared_path
from ..sources.tables import load
from .base import query

SECRETS = r"""'{"k": ' || json_extract_string(props, '$.k') || ', "user": {"Password": "p' || event_id || '", "id": ' || user_id || '}, "list": [{"token": [1, {"a": 2}]}, "token", 3.5], "loc": ["body", "API_KEY"], "input": "sk-' || user_id || '", "x": null}'"""


@query(
    r"""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"user":{"Password":"***","id":' || user_id || '},"list":[{"token":"***"},"token",3.5],"loc":["body","API_KEY"],"input":"***","x":null}' AS masked FROM events"""
)
def redact_props(spark, sf_dir):
    """Properties with secrets inside, masked by the names of fields at any depth; what was put into a field that an error's place names, too."""
    raw = F.concat(F.lit('{"k": '), "k", F.lit(', "user": {"Password": "p'), "event_id", F.lit('", "id": '), "user_id", F.lit('}, "list": [{"token": [1, {"a": 2}]}, "token", 3.5], "loc": ["body", "API_KEY"], "input": "sk-'), "user_id", F.lit('", "x": null}'))
    return load(spark, sf_dir, "events").select("event_id", redact.masked_json(raw).alias("masked"))


@query("""SELECT c_custkey, '***' AS password, c_name AS name, '***' AS token, CAST(c_nationkey AS VARCHAR) AS nation, '***' AS secret, c_mktsegment AS phone,
    CASE WHEN c_custkey % 2 = 0 THEN '***' ELSE c_name END AS input, CASE WHEN c_custkey % 3 > 0 THEN '***' END AS authorization FROM customer""")
def redact_fields(spark, sf_dir):
    """Secrets in structs, lists and maps of a row are masked inside the JVM, the rest stays as it is."""
    c = load(spark, sf_dir, "customer")
    nested = c.select(
        "c_custkey",
        F.struct(F.col("c_mktsegment").alias("Password"), F.col("c_name").alias("name"), F.array(F.struct(F.col("c_acctbal").alias("TOKEN"), "c_nationkey")).alias("list")).alias("account"),
        F.create_map(F.lit("Secret"), F.col("c_name"), F.lit("phone"), F.col("c_mktsegment")).alias("extra"),
        F.struct(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("body"), F.lit("api_key"))).alias("loc"), F.col("c_name").alias("input")).alias("error"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("authorization"),
    )
    r = redact.redacted(nested)
    item = F.col("account.list")[0]
    return r.select("c_custkey", F.col("account.Password").alias("password"), "account.name", item["TOKEN"].alias("token"), item["c_nationkey"].cast("string").alias("nation"), F.col("extra")["Secret"].alias("secret"), F.col("extra")["phone"].alias("phone"), "error.input", "authorization")


#: A stand-in for a model's score that SQL can give too; pairs of long questions have none.
SCORE = "CASE WHEN length(query) % 5 > 0 THEN (length(text) * 7 + length(query)) % 101 / CAST(101 AS DOUBLE) END"
PAIRS = "(SELECT a.conv_id, a.turn AS asked, b.turn, a.text AS query, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant')"


def _pairs(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("query"))
    return scores.keyed(a.join(c.filter("role = 'assistant'").select("conv_id", "turn", "text"), "conv_id"), "stand-in")


@query(f"""SELECT count(*) AS pairs, count(*) FILTER (asked < 2) AS kept, count(*) FILTER (asked >= 2) AS computed FROM (SELECT query, text, min(asked) AS asked FROM {PAIRS} WHERE {SCORE} IS NOT NULL GROUP BY 1, 2)""")
def score_cache(spark, sf_dir):
    """Two rounds of scores: the second asks for the pairs of both, and computes only those that the first has not."""
    pairs = _pairs(spark, sf_dir)
    first = scores.refreshed(spark.createDataFrame([], scores.SCHEMA), pairs.filter("asked < 2"), F.expr(SCORE), 1)
    new = scores.missing(pairs, first).filter(F.expr(SCORE).isNotNull())
    both = scores.refreshed(first, pairs, F.expr(SCORE), 2)
    sums = both.agg(F.count("*").alias("pairs")).crossJoin(F.broadcast(first.agg(F.count("*").alias("kept")))).crossJoin(F.broadcast(new.agg(F.count("*").alias("computed"))))
    return sums.select("pairs", "kept", "computed")


@query(f"""WITH s AS (SELECT *, {SCORE} AS score FROM {PAIRS}), f AS (SELECT *, max(score IS NOT NULL) OVER (PARTITION BY conv_id, asked) AS scored FROM s)
    SELECT conv_id, asked, turn, score, CASE WHEN scored THEN 'score' ELSE 'fallback' END AS origin, row_number() OVER (PARTITION BY conv_id, asked ORDER BY score DESC NULLS LAST, turn) AS rank FROM f WHERE NOT scored OR score IS NOT NULL QUALIFY rank <= 3""")
def rerank_candidates(spark, sf_dir):
    """Candidates by kept scores; a question without any keeps the order of recall."""
    pairs = _pairs(spark, sf_dir)
    cache = scores.refreshed(spark.createDataFrame([], scores.SCHEMA), pairs, F.expr(SCORE), 1)
    return scores.reranked(pairs, cache, ["conv_id", "asked"], [F.asc("turn")], 3).select("conv_id", "asked", "turn", "score", "origin", "rank")


def _parse(row):
    if row["text"].startswith("The"):
        raise ValueError("starts with The")
    return {"lines": row["text"].split("\n")}


def _count(row):
    if len(row["lines"]) > 4:
        raise OverflowError(len(row["lines"]))
    return {"words": sum(len(x.split()) for x in row["lines"])}


@query("""SELECT id, CASE WHEN starts_with(text, 'The') OR n > 4 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN starts_with(text, 'The') THEN 'parse' ELSE 'count' END AS stage,
    CASE WHEN starts_with(text, 'The') THEN 'ValueError: starts with The' WHEN n > 4 THEN 'OverflowError: ' || n END AS error FROM (SELECT conv_id * 1000 + turn AS id, text, len(string_split(text, chr(10))) AS n FROM conversations)""")
def stage_status(spark, sf_dir):
    """Two stages over chats: one that fails stops itself alone, and its state says where and why."""
    docs = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    steps = [stages.Stage("parse", stages.each_row(_parse, "id", "lines array<string>")), stages.Stage("count", stages.each_row(_count, "id", "words long"))]
    return stages.run_stages(docs, "id", steps, shared_path(spark))
