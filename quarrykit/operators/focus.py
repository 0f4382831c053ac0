"""From an answer's marker to its claim, and from a claim to the sentences of a chunk that it rests on.

Chunks are cut into sentences once, whatever the number of claims; claims meet the sentences of their own hits by a join.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of sentences, what may stand between a claim and its marker, words and codes, characters that count in pairs, lines that are no sentences.
ENDS = r"([。！？；!?;]+)|(\.)(\s+)|(\n+)"
TRAILING = "[。！？；!?;.，,、 \n\t*_`~)）」』”’】]+$"
WORD, WIDE = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", "[㐀-鿿]"
HEADING, RULE = r"^#{1,6}\s", r"^\|?\s*:?-{3,}"
#: Characters before a marker that may hold its claim; weight of a heading's words; score of a sentence to be told; share of the best that draws a neighbour in.
LOOKBACK, HEADING_WEIGHT, LEAST, NEIGHBOUR = 160, 0.5, 0.18, 0.7
SPACE = " \t\n\r\x0b\x0c"
_CUT, _BODY = "\x01", "\x02"


def claim_before(answer: Column) -> Column:
    """The sentence that ends a text, without marks of emphasis around it."""
    window = F.right(F.regexp_replace(answer, TRAILING, ""), F.lit(LOOKBACK))
    return F.btrim(F.regexp_replace(window, r"(?s)^.*(?:[。！？；!?;]|\.\s|\n)", ""), F.lit(" *_-#>\n"))


def claims(answers: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """(keys, pos, marker, claim) of each marker [^c<n>] of an answer, in order."""
    parts = F.split(F.regexp_replace(answer, r"(\[\^c\d+\])", _CUT + "$1"), _CUT)
    at = answers.select(*keys, parts.alias("p")).select(*keys, "p", F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("pos", "part"))
    before = F.array_join(F.slice("p", F.lit(1), F.col("pos") + 1), "")
    return at.select(*keys, "pos", F.regexp_extract("part", r"^\[\^c(\d+)\]", 1).cast("int").alias("marker"), claim_before(before).alias("claim"))


def terms(text: Column) -> Column:
    """Distinct words and codes in lower case, and pairs of neighbouring wide characters."""
    low = F.lower(text)
    wide = F.array_join(F.regexp_extract_all(low, F.lit(f"({WIDE})"), F.lit(1)), "")
    pairs = F.when(F.length(wide) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(wide) - 1, F.lit(1))), lambda i: F.substring(wide, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)), pairs))


def likeness(claim: Column, sentence: Column) -> Column:
    """Shared terms, words and codes twice, over the root of the product of both numbers of terms."""
    shared = F.array_intersect(claim, sentence)
    weight = F.size(shared) + F.size(F.filter(shared, lambda t: t.rlike(f"^{WORD}$")))
    return F.when((F.size(claim) > 0) & (F.size(sentence) > 0), weight / F.sqrt((F.size(claim) * F.size(sentence)).cast("double"))).otherwise(0.0)


def sentence_table(chunks: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n, start, end, heading, terms, heading_terms, of) of the sentences of each chunk that can be quoted, of being their number: headings and short
    pieces are none, but a heading counts for the sentences below it."""
    parts = F.split(F.regexp_replace(content, ENDS, f"$1$2{_CUT}$3$4{_BODY}"), _CUT)
    p = chunks.select(key, F.posexplode(parts).alias("i", "part")).withColumn("skip", F.when(F.col("i") > 0, F.instr("part", _BODY) - 1).otherwise(0))
    p = p.withColumn("body", F.substring("part", F.when(F.col("i") > 0, F.col("skip") + 2).otherwise(1), F.length("part"))).withColumn("bare", F.btrim("body", F.lit(SPACE)))
    by = Window.partitionBy(key).orderBy("i")
    before = F.coalesce(F.sum(F.col("skip") + F.length("body")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("skip")
    is_heading = F.col("bare").rlike(HEADING)
    heading = F.last(F.when(is_heading, F.btrim(F.regexp_replace("bare", "^#+", ""), F.lit(SPACE))), ignorenulls=True).over(by)
    lead = F.length("body") - F.length(F.ltrim(F.col("body"), F.lit(SPACE)))
    s = p.withColumns({"start": (before + lead).cast("int"), "heading": F.coalesce(heading, F.lit(""))}).filter(~is_heading & (F.length("bare") >= 4) & ~F.col("bare").rlike(RULE))
    s = s.withColumn("n", F.row_number().over(by)).withColumn("of", F.count("*").over(Window.partitionBy(key)))
    return s.select(key, "n", "start", (F.col("start") + F.length("bare")).cast("int").alias("end"), "heading", terms(F.col("bare")).alias("terms"), terms(F.col("heading")).alias("heading_terms"), "of")


def focus(hits: DataFrame, sentences: DataFrame, keys: list[str], key: str, claim: str) -> DataFrame:
    """(keys, key, start, end, score) of hits(keys, key, claim) for which a sentence of the chunk is told: the one most like the claim and, where it is nearly as
    like, the one before it or else the one after. Claims of one term, chunks of one sentence and faint likenesses give no row."""
    h = hits.select(*keys, key, terms(F.col(claim)).alias("__c")).filter(F.size("__c") >= 2)
    scored = h.join(sentences.filter("of >= 2"), key).withColumn("score", likeness(F.col("__c"), F.col("terms")) + HEADING_WEIGHT * likeness(F.col("__c"), F.col("heading_terms")))
    by = Window.partitionBy(*keys, key).orderBy("n")
    near = {f"{side}_{c}": f(c).over(by) for side, f in (("before", F.lag), ("after", F.lead)) for c in ("score", "start", "end")}
    best = scored.withColumns(near).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, key).orderBy(F.desc("score"), "n"))).filter((F.col("__r") == 1) & (F.col("score") >= LEAST))
    back = F.coalesce(F.col("before_score") >= F.col("score") * NEIGHBOUR, F.lit(False))
    on = ~back & F.coalesce(F.col("after_score") >= F.col("score") * NEIGHBOUR, F.lit(False))
    return best.select(*keys, key, F.when(back, F.col("before_start")).otherwise(F.col("start")).alias("start"), F.when(on, F.col("after_end")).otherwise(F.col("end")).alias("end"), F.round("score", 9).alias("score"))
