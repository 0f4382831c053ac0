"""Context for answers: steps that run along one query's evidence or along one text."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import WIDE_CHUNK, estimate, sentence_ends, sentences
from .evidence import shares
from .groups import along_groups

EVIDENCE_BUDGET, EVIDENCE_LEAST = 2000, 120
TRIM_CHARS, TRIM_TOKENS = 16, 40


def tokens_of(text: str) -> int:
    return estimate(text, WIDE_CHUNK)


def allocate(df: DataFrame, budget: int = EVIDENCE_BUDGET, least: int = EVIDENCE_LEAST) -> DataFrame:
    """df(query_id, pos, demand, ...) with the column granted; weights are 1 / (place + 2)."""

    def step(rows):
        granted = shares([1 / (r + 2) for r in range(len(rows))], [r["demand"] for r in rows], budget, least)
        return [r | {"granted": g} for r, g in zip(rows, granted)]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return along_groups(df, ["query_id"], ["pos"], step, f"{fields}, granted long")


def _shared(earlier: str, later: str) -> int:
    """Characters at the start of later, with the white space after them, that end earlier; both sides of the cut lie where sentences do, the longest is taken."""
    body = earlier.rstrip()
    starts = {len(body[:e].rstrip()) for e in [0, *sentence_ends(body)]}
    for e in reversed(sentence_ends(later)):
        part = later[:e].rstrip()
        if len(part) < TRIM_CHARS:
            break
        if body.endswith(part) and len(body[: len(body) - len(part)].rstrip()) in starts:
            return len(later) - len(later[e:].lstrip())
    return 0


def without_overlaps(rows: list[dict]) -> list[dict]:
    """Rows(doc, ordinal, start, end, content), best first, without text that a kept neighbour of the same document holds already.

    A cut lies where a sentence ends on both sides and takes TRIM_CHARS characters at least; what is left of fewer than TRIM_TOKENS tokens goes.
    """
    kept: list[dict] = []
    for row in map(dict, rows):
        cut = False
        for other in kept:
            if other["doc"] != row["doc"] or abs(other["ordinal"] - row["ordinal"]) != 1:
                continue
            a, b = (other["content"], row["content"]) if other["ordinal"] < row["ordinal"] else (row["content"], other["content"])
            n = _shared(a, b)
            if not n:
                continue
            cut = True
            if other["ordinal"] < row["ordinal"]:
                row["content"], row["start"] = row["content"][n:], row["start"] + n
            else:
                left = len(a.rstrip()) - len(b[:n].rstrip())
                row["content"], row["end"] = a[:left], row["end"] - (len(a) - left)
        if not cut or tokens_of(row["content"]) >= TRIM_TOKENS:
            kept.append(row)
    return kept


def trim_overlap(df: DataFrame) -> DataFrame:
    """without_overlaps() for each query's evidence, by pos."""
    return along_groups(df, ["query_id"], ["pos"], without_overlaps, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def ground(df: DataFrame, text: str, source: str, out: str) -> DataFrame:
    """df with the column out: text without the sentences of whose distinctive terms two or more, and over half, are missing in source.

    Terms are words of four letters and more and numbers; there is no part-of-speech tagger here.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, {out} string"

    def grounded(t: str | None, s: str | None) -> str:
        have = set(re.findall(r"[^\W\d_]{4,}|\d+", (s or "").casefold()))
        keep = []
        for part in sentences(t or ""):
            terms = set(re.findall(r"[^\W\d_]{4,}|\d+", part.casefold()))
            missing = len(terms - have)
            if not (missing >= 2 and 2 * missing > len(terms)):
                keep.append(part)
        return "".join(keep)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: [grounded(t, s) for t, s in zip(pdf[text], pdf[source], strict=True)]})

    return df.mapInPandas(run, schema)


def compact_history(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns of each conversation(conv_id, turn, text, tokens) that fit; the newest always stays, and the first that doesn't fit ends it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    run = turns.withColumns({"__sum": F.sum("tokens").over(w), "__r": F.row_number().over(w)})
    return run.filter((F.col("__sum") <= budget) | (F.col("__r") == 1)).drop("__sum", "__r")
