"""What a model's text holds of JSON: whole documents parsed inside the JVM, closed elements of broken ones found by a scanner, items checked one by one."""

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged

#: Fences of code around an answer (a fixed pattern).
FENCE = r"(?m)^\s*```(?:json)?\s*|\s*```\s*$"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]', re.DOTALL)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column name, computed once for each row: a plain column is put into every expression and filter that names it, and is parsed again for each."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_parsed(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with, as a variant, the first of these that is JSON: the text, the text without fences, from its first { to its last }, from its first [ to its last ] if no {
    comes before; null if none is. A list is the field items of an object."""
    # what can't begin a JSON document isn't tried, since each failure costs the JVM an exception
    json = lambda c: F.when(c.rlike(r"^\s*[\[{\"\-0-9tfn]"), F.try_parse_json(c))
    new = lambda c, *tried: F.when(~F.coalesce(*((c == t) for t in tried), F.lit(False)), c)
    df = once(df, "__whole", json(F.col(text)))
    df = once(df, "__bare", F.when(F.col("__whole").isNull(), F.trim(F.when(F.contains(F.col(text), F.lit("```")), F.regexp_replace(text, FENCE, "")).otherwise(F.col(text)))))
    bare = F.col("__bare")
    df = once(df, "__braces", F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    brackets = F.when(~F.regexp_extract(bare, r"(?s)^[^\[]*", 0).contains("{"), F.regexp_extract(bare, r"(?s)\[.*\]", 0))
    df = once(df, "__found", F.coalesce("__whole", json(new(bare, F.col(text))), json(new(F.col("__braces"), bare)), json(brackets)))
    found = F.col("__found")
    listed = F.try_variant_get(found, "$", "array<variant>").isNotNull()
    v = F.when(listed, F.parse_json(F.concat(F.lit('{"items":'), F.to_json(found), F.lit("}")))).otherwise(found)
    return once(df, name, v).drop("__whole", "__bare", "__braces", "__found")


def closed_elements(text: str) -> list[tuple[str, str]]:
    """(field, element) of the objects that are closed in the lists of the first object of a text, broken off as it may be, in order.

    A stack of open brackets tells how deep a place lies; strings are single tokens, so brackets inside them don't count.
    """
    begin = text.find("{")
    if begin < 0:
        return []
    out: list[tuple[str, str]] = []
    open_: list[str] = []
    field = name = None
    start = 0
    for m in _TOKEN.finditer(text, begin):
        t = m[0]
        if t[0] == '"':
            if len(open_) == 1:
                name = t
        elif t in "[{":
            if len(open_) == 1:
                field = name if t == "[" else None
            elif len(open_) == 2 and t == "{":
                start = m.start()
            open_.append(t)
        elif t in "]}":
            open_.pop()
            if not open_:
                break
            if len(open_) == 2 and open_[1] == "[" and t == "}" and field:
                out.append((field, text[start : m.end()]))
        elif t == "," and len(open_) == 1:
            name = None
    kept = []
    for f, element in out:
        try:
            json.loads(element)
            kept.append((json.loads(f), element))
        except ValueError:
            continue
    return kept


def items(df: DataFrame, keys: list[str], text: str, fields: list[str], json: bool = True) -> DataFrame:
    """(keys, how, field, pos, item) of the elements of the lists ``fields`` in each text; how is 'parsed' or 'salvaged', item the element as JSON, or
    as a variant without ``json``. A text without a readable element gives no row. Only texts that are no JSON leave the JVM."""
    read = with_parsed(df.select(*keys, text), text, "__v")
    lists = F.array(*(F.struct(F.lit(f).alias("field"), F.try_variant_get("__v", f"$.{f}", "array<variant>").alias("list")) for f in fields))
    # written, as both branches below would parse all texts
    read = staged(read.select(*keys, F.when(F.col("__v").isNull(), F.col(text)).alias(text), F.when(F.col("__v").isNotNull(), lists).alias("__l")))
    flat = read.filter("__l IS NOT NULL").select(*keys, F.explode("__l").alias("l")).select(*keys, "l.field", F.posexplode("l.list").alias("pos", "item"))
    whole = flat.select(*keys, F.lit("parsed").alias("how"), "field", "pos", (F.to_json("item") if json else F.col("item")).alias("item"))
    rest = read.filter(F.col(text).isNotNull()).select(*keys, text)
    n = len(keys)
    kinds = [(f.name, f.dataType.simpleString()) for f in rest.schema][:n]

    def run(batches):
        for batch in batches:
            at, field, pos, item = [], [], [], []
            for i, t in enumerate(batch.column(n)):
                count: dict[str, int] = {}
                for f, element in closed_elements(t.as_py()):
                    if f in fields:
                        at.append(i)
                        field.append(f)
                        pos.append(count.get(f, 0))
                        item.append(element)
                        count[f] = pos[-1] + 1
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(["salvaged"] * len(at), pa.string()), pa.array(field, pa.string()), pa.array(pos, pa.int32()), pa.array(item, pa.string())], names=[*keys, "how", "field", "pos", "item"])

    schema = ", ".join(f"{k} {t}" for k, t in kinds) + ", how string, field string, pos int, item string"
    closed = rest.mapInArrow(run, schema)
    return whole.unionByName(closed if json else closed.withColumn("item", F.try_parse_json("item")))


#: Kinds of cards, other words for them, the confidence of a card that has none.
KINDS = ("concept", "fact", "procedure", "pitfall", "tool")
KIND_WORDS = {"概念": "concept", "定义": "concept", "事实": "fact", "数值": "fact", "参数": "fact", "流程": "procedure", "步骤": "procedure", "操作": "procedure", "坑": "pitfall", "注意事项": "pitfall", "陷阱": "pitfall", "工具": "tool"}
CONFIDENCE = 0.5


def as_strings(value: Column) -> Column:
    """A variant that is a list as the texts of its elements without outer space, empty ones left out; one that is a text as its only one; others as none."""
    listed = F.filter(F.transform(F.array_compact(F.try_variant_get(value, "$", "array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    one = F.when(F.schema_of_variant(value) == "STRING", F.filter(F.array(F.try_variant_get(value, "$", "string")), lambda x: F.trim(x) != ""))
    return F.coalesce(listed, one, F.array().cast("array<string>"))


def cards(found: DataFrame, keys: list[str], kinds: dict[str, str] = KIND_WORDS) -> DataFrame:
    """found(keys, pos, item), items as JSON or variants, with the columns of a card: kind, title, body, aliases, markers, confidence, and ok; what is not ok is skipped by who reads it.

    kinds gives other words for the kinds of cards. A card needs a known kind, a title and a body; its confidence lies in 0..1 and is CONFIDENCE where it is no
    number; lists may be scalars.
    """
    fields = ("kind", "title", "body", "aliases", "source_chunk_markers", "confidence")
    found = once(found, "__v", F.col("item") if found.schema["item"].dataType.typeName() == "variant" else F.try_parse_json("item"))
    found = once(found, "__f", F.struct(*(F.try_variant_get("__v", f"$.{f}", "variant").alias(f) for f in fields))).drop("__v")
    text = lambda f: F.when(F.schema_of_variant(F.col(f"__f.{f}")) == "STRING", F.try_variant_get(f"__f.{f}", "$", "string"))
    word = F.lower(F.trim(text("kind")))
    table = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)) if kinds else F.lit(None).cast("map<string,string>")
    kind = F.coalesce(F.try_element_at(table, word), word)
    number = F.col("__f.confidence")
    confidence = F.when(F.schema_of_variant(number) == "BOOLEAN", CONFIDENCE).otherwise(F.coalesce(F.try_variant_get(number, "$", "double"), F.lit(CONFIDENCE)))
    out = found.withColumns({
        "kind": kind, "title": text("title"), "body": text("body"),
        "aliases": as_strings(F.col("__f.aliases")), "markers": as_strings(F.col("__f.source_chunk_markers")),
        "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)),
    }).drop("__f")
    # only an object has a kind
    return out.withColumn("ok", F.coalesce(F.col("kind").isin(*KINDS) & (F.length("title") > 0) & (F.length("body") > 0), F.lit(False)))
