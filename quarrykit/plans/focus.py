"""Claims of answers and the sentences that they rest on."""

from pyspark.sql import functions as F

from ..operators import focus
from ..streaming import citations
from ..sources.tables import load
from .base import query

#: Answers: what the assistant said, with a marker at each line's end and after each question mark.
ANSWERS = r"""(SELECT conv_id, turn, regexp_replace(replace(text, chr(10), ' [^c1]' || chr(10)), '([a-z])\. ([A-Z])', '\1**.[^c' || (turn + 2) || '] \2') || '[^c9]' AS answer FROM conversations WHERE role = 'assistant')"""


def _answers(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    first = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" [^c1]\n")), r"^(?s)(.*?[a-z])\. ([A-Z])", "$1**.[^c__] $2")
    return c.select("conv_id", "turn", F.concat(F.replace(first, F.lit("[^c__]"), F.concat(F.lit("[^c"), F.col("turn") + 2, F.lit("]"))), F.lit("[^c9]")).alias("answer"))


CLAIMS = rf"""(SELECT conv_id, turn, pos, CAST(regexp_extract(p[pos + 2], '^\[\^c(\d+)\]', 1) AS INTEGER) AS marker,
    trim(regexp_replace(right(regexp_replace(array_to_string(p[1:pos + 1], ''), '{focus.TRAILING}', ''), {focus.LOOKBACK}), '^.*(?:[。！？；!?;]|\.\s|\n)', '', 's'), ' *_-#>' || chr(10)) AS claim
    FROM (SELECT *, CAST(unnest(generate_series(0, len(p) - 2)) AS INTEGER) AS pos FROM (SELECT conv_id, turn, string_split(regexp_replace(answer, '(\[\^c\d+\])', chr(1) || '\1', 'g'), chr(1)) AS p FROM {ANSWERS})))"""


@query(f"SELECT * FROM {CLAIMS}")
def claim_texts(spark, sf_dir):
    """The claim before each marker of an answer."""
    return focus.claims(_answers(spark, sf_dir), ["conv_id", "turn"], "answer")


#: Chunks: every turn under a heading, with a rule and a short line that can't be quoted.
CHUNKS = "(SELECT conv_id * 1000 + turn AS id, '# Turn ' || turn || chr(10) || '----' || chr(10) || 'ok' || chr(10) || text AS content FROM conversations)"
SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _terms(x: str) -> str:
    wide = f"array_to_string(regexp_extract_all(lower({x}), '[㐀-鿿]'), '')"
    return rf"list_distinct(list_concat(regexp_extract_all(lower({x}), '{focus.WORD}'), list_transform(generate_series(1, length({wide}) - 1), lambda i: substr({wide}, i, 2))))"


def _like(b: str) -> str:
    both = f"list_intersect(c, {b})"
    return f"CASE WHEN len(c) > 0 AND len({b}) > 0 THEN (len({both}) + len(list_filter({both}, lambda t: regexp_full_match(t, '{focus.WORD}')))) / sqrt(CAST(len(c) * len({b}) AS DOUBLE)) ELSE 0.0 END"


SENTENCES = rf"""p AS (SELECT id, i - 1 AS i, part, CASE WHEN i > 1 THEN strpos(part, chr(2)) - 1 ELSE 0 END AS skip FROM (SELECT id, unnest(l) AS part, generate_subscripts(l, 1) AS i FROM
        (SELECT id, string_split(regexp_replace(content, '{focus.ENDS}', '\1\2' || chr(1) || '\3\4' || chr(2), 'g'), chr(1)) AS l FROM {CHUNKS}))),
    b AS (SELECT *, CASE WHEN i > 0 THEN substr(part, skip + 2) ELSE part END AS body FROM p),
    h AS (SELECT *, trim(body, {SPACES}) AS bare, coalesce(sum(skip + length(body)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + skip AS place FROM b),
    g AS (SELECT *, regexp_matches(bare, '{focus.HEADING}') AS is_heading, last_value(CASE WHEN regexp_matches(bare, '{focus.HEADING}') THEN trim(regexp_replace(bare, '^#+', ''), {SPACES}) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS heading FROM h),
    s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS n, CAST(place + length(body) - length(ltrim(body, {SPACES})) AS INTEGER) AS "start", bare, coalesce(heading, '') AS heading, count(*) OVER (PARTITION BY id) AS of
        FROM g WHERE NOT is_heading AND length(bare) >= 4 AND NOT regexp_matches(bare, '{focus.RULE}'))"""


def _sentences(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    content = F.concat(F.lit("# Turn "), "turn", F.lit("\n----\nok\n"), "text")
    return focus.sentence_table(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), content.alias("content")), "id", "content")


@query(f"""WITH {SENTENCES} SELECT id, n, "start", CAST("start" + length(bare) AS INTEGER) AS "end", heading, of FROM s""")
def sentence_spans(spark, sf_dir):
    """Sentences of chunks that can be quoted, with their places and the heading above."""
    return _sentences(spark, sf_dir).select("id", "n", "start", "end", "heading", "of")


@query(f"""WITH {SENTENCES}, q AS (SELECT a.conv_id, a.turn, a.pos, x.conv_id * 1000 + x.turn AS id, {_terms('a.claim')} AS c FROM {CLAIMS} a JOIN conversations x ON a.conv_id = x.conv_id),
    t AS (SELECT *, "start" + length(bare) AS "end", {_terms('bare')} AS w, {_terms('heading')} AS hw FROM s WHERE of >= 2),
    r AS (SELECT conv_id, turn, pos, id, n, "start", "end", {_like('w')} + {focus.HEADING_WEIGHT} * {_like('hw')} AS score FROM q JOIN t USING (id) WHERE len(c) >= 2),
    z AS (SELECT *, lag(score) OVER o AS bs, lag("start") OVER o AS b, lead(score) OVER o AS fs, lead("end") OVER o AS f, row_number() OVER (PARTITION BY conv_id, turn, pos, id ORDER BY score DESC, n) AS k FROM r WINDOW o AS (PARTITION BY conv_id, turn, pos, id ORDER BY n))
    SELECT conv_id, turn, pos, id, CASE WHEN bs >= score * {focus.NEIGHBOUR} THEN b ELSE "start" END AS "start",
        CAST(CASE WHEN coalesce(bs >= score * {focus.NEIGHBOUR}, false) THEN "end" WHEN fs >= score * {focus.NEIGHBOUR} THEN f ELSE "end" END AS INTEGER) AS "end", round(score, 9) AS score FROM z WHERE k = 1 AND score >= {focus.LEAST}""")
def focus_hits(spark, sf_dir):
    """For each claim, the sentences that it rests on in each turn of its conversation."""
    c = load(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    hits = claim_texts(spark, sf_dir).join(c, "conv_id")
    return focus.focus(hits, _sentences(spark, sf_dir), ["conv_id", "turn", "pos"], "id", "claim")


#: Answers in pieces of seven characters; of their markers c1, c3 and c9 are known.
MARKED = rf"""(SELECT conv_id * 1000 + turn AS message, replace(answer, '[^c3]', '[^3] and [^x1]') AS answer FROM {ANSWERS})"""


@query(rf"""WITH p AS (SELECT message, string_split(regexp_replace(regexp_replace(answer, '\[\^[A-Za-z]([0-9]+)\]', chr(1) || '\1' || chr(2), 'g'), '\[\^([139])\]', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM {MARKED}),
    e AS (SELECT message, i, 'c' || string_split(l[i], chr(2))[1] AS marker, length(l[1]) + coalesce(list_sum(list_transform(l[2:i - 1], lambda x: length(string_split(x, chr(2))[2]))), 0) AS place,
          l[1] || array_to_string(list_transform(l[2:], lambda x: string_split(x, chr(2))[2]), '') AS text FROM (SELECT message, l, unnest(generate_series(2, len(l))) AS i FROM p))
    SELECT message, marker, CAST(place AS INTEGER) AS char_offset, text FROM e WHERE marker IN ('c1', 'c3', 'c9') QUALIFY row_number() OVER (PARTITION BY message, marker ORDER BY i) = 1""")
def citation_stream(spark, sf_dir):
    """Citations of answers that come in pieces, wherever the pieces end: each known marker once, with its place in the text without markers."""
    a = _answers(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.replace("answer", F.lit("[^c3]"), F.lit("[^3] and [^x1]")).alias("answer"))
    n = F.ceil(F.length("answer") / 7).cast("int")
    p = a.select("message", "answer", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    known = F.when(F.col("seq") == 0, F.array(F.lit("c1"), F.lit("c3"), F.lit("c9")))
    return citations.cited(p.select("message", "seq", F.substring("answer", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), known.alias("known")))
