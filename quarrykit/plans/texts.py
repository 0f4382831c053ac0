"""Text functions and text integrity over documents, pages and conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, retrieval, similar
from ..sources.tables import load
from .base import query


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY 2")
def exact_dedup(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "sha", "copies")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'),
    '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def html_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 4096), '(?is)<title[^>]*>.*?</title>') THEN trim(regexp_extract(substr(html, 1, 4096), '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE url END AS title FROM pages")
def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html"), F.col("url")).alias("title"))


@query("SELECT doc_id, CAST(n + ceil((length(text) - n) / 4.0) AS BIGINT) AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS n FROM documents)")
def token_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(n + ceil((length(text) - n) / 4.0) AS BIGINT) AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{f900}-\\x{faff}]')) AS n FROM documents)")
def token_estimate_ingest(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text"), T.CJK_INGEST).alias("tokens"))


GRAMS = r"list_distinct(CASE WHEN length(t) < 4 THEN [t] ELSE list_transform(generate_series(1, length(t) - 3), lambda i: substr(t, i, 4)) END)"
NORM = r"trim(lower(regexp_replace(text, '[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')))"


@query(f"""WITH d AS (SELECT item_id, {GRAMS} AS g FROM (SELECT item_id, {NORM} AS t FROM benchmark))
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) AS similarity FROM d a JOIN d b ON b.item_id = a.item_id + 1""")
def ngram_similarity(spark, sf_dir):
    d = load(spark, sf_dir, "benchmark").select("item_id", T.char_ngrams(T.normalized(F.col("text"))).alias("g"))
    b = d.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("g").alias("gb"))
    return d.join(b, "item_id").select(F.col("item_id").alias("a"), "b", F.round(T.overlap_coefficient(F.col("g"), F.col("gb")), 6).alias("similarity"))


#: Turns, the same without their first characters, and first turns once more.
RETOLD = "(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 500, substr(text, 6) FROM conversations UNION ALL SELECT conv_id, turn + 700, text FROM conversations WHERE turn = 0)"


@query(f"""WITH d AS (SELECT min(id) AS id, list(id) AS ids, g FROM (SELECT conv_id * 1000 + turn AS id, list_sort({GRAMS}) AS g FROM (SELECT conv_id, turn, {NORM} AS t FROM {RETOLD})) GROUP BY g)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) AS similarity FROM d a JOIN d b ON a.id < b.id
    WHERE len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) > 0.85
    UNION ALL SELECT id, b, 1.0 FROM (SELECT id, unnest(ids) AS b FROM d) WHERE b <> id""")
def near_dup_pairs(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    again = c.select((id_ + 500).alias("id"), F.substring("text", 6, 1 << 30).alias("text")).unionByName(c.filter("turn = 0").select((id_ + 700).alias("id"), "text"))
    return similar.similar_pairs(c.select(id_.alias("id"), "text").unionByName(again), "id", "text", 0.85)


@query()
def near_dup_greedy(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return retrieval.suppress_redundant(c)


@query(r"""SELECT doc_id, i - 1 AS line_no, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '…' ELSE s END AS snippet FROM
    (SELECT doc_id, i, trim(regexp_replace(s, '[ \t]+', ' ', 'g')) AS s FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def line_snippets(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "s"))
    return d.select("doc_id", "line_no", T.snippet(F.col("s")).alias("snippet"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 40) || ' … ' || right(text, 20) ELSE text END AS short FROM conversations")
def truncate_middle(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate_middle(F.col("text"), 60).alias("short"))


ANSWERS = "(SELECT conv_id, turn, 'See [^c' || (turn + 1) || '] and [^' || (conv_id % 5) || '] then [^c' || (turn + 1) || '].' AS answer FROM conversations WHERE role = 'assistant')"


def _answers(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.concat(F.lit("See [^c"), F.col("turn") + 1, F.lit("] and [^"), F.col("conv_id") % 5, F.lit("] then [^c"), F.col("turn") + 1, F.lit("].")).alias("answer"))


@query(rf"SELECT conv_id, turn, CAST(list_transform(regexp_extract_all(answer, '\[\^[a-z]?([0-9]+)\]', 1), lambda x: CAST(x AS INT)) AS VARCHAR) AS markers FROM {ANSWERS}")
def citation_markers(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", T.citation_markers(F.col("answer")).cast("string").alias("markers"))


@query(rf"""WITH m AS (SELECT conv_id, turn, unnest(l) AS c, generate_subscripts(l, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(answer, '\[\^[a-z]?([0-9]+)\]', 1) AS l FROM {ANSWERS})),
    f AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, turn, c) AS first FROM m)
    SELECT conv_id, turn, pos - 1 AS pos, CAST(c AS INT) AS marker, dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY first) AS number FROM f""")
def display_numbering(spark, sf_dir):
    m = _answers(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.citation_markers(F.col("answer"))).alias("pos", "marker"))
    m = m.withColumn("first", F.min("pos").over(Window.partitionBy("conv_id", "turn", "marker")))
    return m.select("conv_id", "turn", "pos", "marker", F.dense_rank().over(Window.partitionBy("conv_id", "turn").orderBy("first")).alias("number"))


@query("""WITH t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations),
    s AS (SELECT *, sum(tokens) OVER w AS s, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, tokens FROM s WHERE s <= 120 OR r = 1""")
def history_compact(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4).alias("tokens"))
    return context.compact_history(c, 120)


#: Ways in which the questions of the queries end, by turn and conversation.
ENDINGS = ("", "请贴出那段文字", "这个原文应该怎么理解", "Please quote it", "那它的半衰期呢？", "第三章写了什么", "unquoted", "How so呢 ?", "一字不差 why")
ASKED = "(SELECT conv_id, turn, text || CASE (conv_id + turn) % 9 " + " ".join(f"WHEN {i} THEN ' {x}'" for i, x in enumerate(ENDINGS)) + " END AS q FROM conversations WHERE role = 'user')"


@query(rf"""SELECT conv_id, turn, regexp_matches(q, '{"|".join(T.VERBATIM)}') AND NOT regexp_matches(q, '{T.PROCEDURAL}') AS verbatim, regexp_matches(q, '{T.ANAPHORA}') OR regexp_matches(q, '{T.FOLLOW_UP}') AS anaphora FROM {ASKED}""")
def intent_flags(spark, sf_dir):
    """Questions that want the words of a source, and those that point back to what was said."""
    c = load(spark, sf_dir, "conversations").filter("role = 'user'")
    ends = F.element_at(F.array(*(F.lit(" " + x) for x in ENDINGS)), ((F.col("conv_id") + F.col("turn")) % len(ENDINGS) + 1).cast("int"))
    q = c.select("conv_id", "turn", F.concat("text", ends).alias("q"))
    return q.select("conv_id", "turn", T.asks_for_source(F.col("q")).alias("verbatim"), T.needs_context(F.col("q")).alias("anaphora"))


PATHS = """(SELECT conv_id, turn, 'The Turn ' || turn || '.MD' AS title, CASE turn % 6 WHEN 0 THEN '# The turn ' || turn || ' in full > Next > ' WHEN 1 THEN 'Other > The Turn ' || turn WHEN 2 THEN 'The Turn ' || turn || ' > the turn ' || turn WHEN 3 THEN ' > '
    WHEN 4 THEN 'The Turn ' || turn || ' > The Turn ' || turn || ' again > End' END AS path FROM conversations)"""


def _title_pairs(x: str) -> str:
    bare = rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return f"CASE WHEN length({bare}) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(generate_series(1, length({bare}) - 1), lambda i: substr({bare}, i, 2))) END"


@query(rf"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(title, '\.(md|markdown|txt|pdf|docx?|html?)$', '', 'i')) AS name, list_filter(list_transform(string_split(path, '>'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {PATHS}),
    e AS (SELECT conv_id, turn, name, parts, i, regexp_replace(parts[i], '^#+\s*', '') AS h FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p)),
    g AS (SELECT *, {_title_pairs("h")} AS a, {_title_pairs("name")} AS b FROM e), k AS (SELECT conv_id, turn, any_value(name) AS name, any_value(parts) AS parts, coalesce(min(i) FILTER (NOT (h = name OR (len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.6))), max(i)) AS first FROM g GROUP BY 1, 2)
    SELECT conv_id, turn, CASE WHEN len(parts[first:]) = 1 AND parts[first] = name THEN NULL ELSE nullif(array_to_string(parts[first:], ' › '), '') END AS label FROM p LEFT JOIN (SELECT conv_id, turn, first FROM k) USING (conv_id, turn)""")
def section_labels(spark, sf_dir):
    """Where a citation stands, without the title that its headings say again."""
    c, turn = load(spark, sf_dir, "conversations"), F.col("turn")
    the = F.concat(F.lit("The Turn "), turn)
    path = (
        F.when(turn % 6 == 0, F.concat(F.lit("# The turn "), turn, F.lit(" in full > Next > ")))
        .when(turn % 6 == 1, F.concat(F.lit("Other > "), the))
        .when(turn % 6 == 2, F.concat(the, F.lit(" > the turn "), turn))
        .when(turn % 6 == 3, " > ")
        .when(turn % 6 == 4, F.concat(the, F.lit(" > "), the, F.lit(" again > End")))
    )
    return c.select("conv_id", "turn", T.section_label(path, F.concat(the, F.lit(".MD"))).alias("label"))


@query()
def ground_sentences(spark, sf_dir):
    p = load(spark, sf_dir, "conversations")
    asked = p.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source_text"))
    both = p.filter("role = 'assistant'").select("conv_id", "turn", "text").join(asked, ["conv_id", "turn"])
    return context.ground(both, "text", "source_text", "grounded")
