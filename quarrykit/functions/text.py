"""Text functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges that count as one token each, for prompt budgets and for chunk sizes (fixed values).
CJK_BUDGET = r"[\x{4e00}-\x{9fff}]"
CJK_INGEST = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{f900}-\x{faff}]"
NGRAM = 4


def estimate_tokens(text: Column, cjk: str = CJK_BUDGET) -> Column:
    """A token for each CJK character, one for every four of the others, rounded up."""
    wide = F.regexp_count(text, F.lit(cjk))
    return (wide + F.ceil((F.length(text) - wide) / 4)).cast("long")


def latin_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def normalized(text: Column) -> Column:
    """Lower case with each run of (Unicode) white space as one space and none outside."""
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))


def char_ngrams(text: Column, n: int = NGRAM) -> Column:
    """Distinct character n-grams; a shorter text is its own only one."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) < n, F.array(text)).otherwise(grams))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements of two sets over the size of the smaller."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def html_to_text(page: Column) -> Column:
    """Plain text of markup: a script or style becomes a space, ends of paragraphs, divisions, items, headings and rows break lines, other tags go, and
    three or more line ends become two. The elements named are fixed by the results."""
    x = F.regexp_replace(page, "(?is)" + "|".join(f"<{t}[^>]*>.*?</{t}>" for t in ("script", "style")), " ")
    x = F.regexp_replace(x, r"(?i)</(p|div|li|h[1-6]|tr)>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_title(page: Column, otherwise: Column, head: int = 4096) -> Column:
    """The title element, empty or not, that opens and closes in the first ``head`` characters; else the other column."""
    title, top = r"(?is)<title[^>]*>(.*?)</title>", F.substring(page, 1, head)
    return F.when(top.rlike(title), F.trim(F.regexp_extract(top, title, 1))).otherwise(otherwise)


def snippet(text: Column, limit: int = 200) -> Column:
    """Runs of spaces and tabs as one, cut to limit characters with an ellipsis."""
    x = F.trim(F.regexp_replace(text, r"[ \t]+", " "))
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x)


def citation_markers(text: Column) -> Column:
    """Numbers of [^c<n>] markers in order of appearance."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\^[a-z]?([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))


def truncate_middle(text: Column, limit: int, marker: str = " … ") -> Column:
    """The first two thirds and the last third of what fits."""
    head = limit * 2 // 3
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(limit - head)))).otherwise(text)


def without_punctuation(text: Column) -> Column:
    """Lower case without ASCII punctuation, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")), r"\s+", " "))


def markdown_plain(text: Column) -> Column:
    """Markdown in one line: fences' lines, marks of headings, quotes and table bars become spaces, links and pictures their texts, emphasis goes; null if nothing is left."""
    for pattern, to in ((r"```[^\n]*", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(^|\s)#{1,6}\s", " "), (r"[*`~]+", ""), (r"[>|]+", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.nullif(F.trim(text), F.lit(""))


def shortened(text: Column, limit: int) -> Column:
    """At most limit characters, an ellipsis among them."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


#: What a model may say before its summary (fixed values).
SUMMARY_PREFIXES = ("文档级上下文：", "上下文：", "摘要：")
SPACE = " \t\n\r\x0b\x0c"


def clean_summary(text: Column, limit: int) -> Column:
    """One line of at most limit characters: without the lines of fences where the text begins with one, and without a prefix; null if nothing is left."""
    bare = lambda c: F.btrim(c, F.lit(SPACE))
    x = bare(text)
    lines = F.filter(F.split(x, r"\r\n|\r|\n"), lambda line: ~bare(line).startswith("```"))
    x = F.when(x.startswith("```"), bare(F.array_join(lines, "\n"))).otherwise(x)
    for prefix in SUMMARY_PREFIXES:
        x = F.when(x.startswith(prefix), bare(F.substring(x, len(prefix) + 1, 1 << 30))).otherwise(x)
    return F.nullif(F.left(bare(F.regexp_replace(x, r"\s+", " ")), F.lit(limit)), F.lit(""))


def salvaged_score(text: Column, field: str, weights: dict[str, float]) -> Column:
    """Of (perhaps broken) JSON, the first number of a field if it lies in 0..1; else the weighted sum of the first numbers of all fields of weights, if each lies
    there; else null."""

    def number(name):
        value = F.regexp_extract(text, f'"{name}"\\s*:\\s*(-?\\d+(?:\\.\\d+)?)', 1).try_cast("double")
        return F.when(value.between(0, 1), value)

    total = sum((F.lit(w) * number(k) for k, w in weights.items()), F.lit(0.0))
    return F.coalesce(number(field), F.round(total, 4))


# Ways to ask for the words of a source, what makes such a question one for a procedure, words that point back, the ending of a follow-up.
VERBATIM = (
    "原文", "原句", "原话", "逐字", "一字不差", "照抄",
    "(贴|粘|复制|引用|摘录|摘抄)(一下|下来|出|来)?(这|那|第)?[^。！？]{0,6}(段|条|句|章|节|部分|内容|文字|正文)",
    r"(第\s*[一二三四五六七八九十百\d]+\s*[章节条]|[这那]一?[段落章节])[^。！？]{0,8}(原文|内容|正文|怎么写的|写了什么|是什么)",
    r"(?i:\b(quote|verbatim|excerpt)\b)",
)
PROCEDURAL = "怎么|如何|为什么|该注意|应该|建议|步骤|流程|判断|对比|区别"
ANAPHORA = "它|他|她|它们|其|其中|该|此|本|这个|那个|这些|那些|这种|那种|上述|前面|刚才|之前|上一条|上面|那么|然后|接着|还有"
FOLLOW_UP = r"呢[？?]?\s*$"


def asks_for_source(question: Column) -> Column:
    """Whether a question wants the words of a source, and not also how to do something."""
    return question.rlike("|".join(VERBATIM)) & ~question.rlike(PROCEDURAL)


def needs_context(question: Column) -> Column:
    """Whether a question can't be read without what was said before."""
    return question.rlike(ANAPHORA) | question.rlike(FOLLOW_UP)


#: Share of the pairs of letters of the shorter one from which a heading counts as the document's title.
TITLE_LIKE = 0.6


def _pairs(text: Column) -> Column:
    bare = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(F.length(bare) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(2)))))


def section_label(path: Column, title: Column) -> Column:
    """The parts of a heading path, joined by ' › ', without leading ones that say the document's title again; null if nothing else is left. The last part goes only if
    it is just the title."""
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda x: x != "")
    name = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\.(md|markdown|txt|pdf|docx?|html?)$", ""))
    own = _pairs(name)

    def like(heading):
        pairs = _pairs(heading)
        return (heading == name) | ((F.size(pairs) > 0) & (F.size(own) > 0) & (F.size(F.array_intersect(pairs, own)) / F.least(F.size(pairs), F.size(own)) >= TITLE_LIKE))

    said = F.transform(parts, lambda x: (name != "") & like(F.regexp_replace(x, r"^#+\s*", "")))
    first = F.array_position(said, False)  # 0 if all say the title
    drop = F.when(first == 0, F.size(parts) - 1).otherwise(first - 1)
    left = F.when(F.size(parts) > 0, F.slice(parts, (drop + 1).cast("int"), F.greatest(F.size(parts), F.lit(1))))
    return F.when((F.size(left) == 1) & (name != "") & (left[0] == name), None).otherwise(F.nullif(F.array_join(left, " › "), F.lit("")))
