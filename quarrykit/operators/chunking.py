"""Chunks of documents that keep to their structure: paragraphs, fenced code, tables, pages.

A chunk is a part of the text, told by its offsets; only further parts of a table carry a copy of its header before theirs. Token budgets are met by inverting
the estimate over sums of characters, so that no part of a text is measured twice.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.sentences import Meter, headings, pages, sentence_ends

TARGET, OVERLAP = 512, 80
#: A header is copied if it takes no more than one part in so many of the budget.
HEADER_SHARE = 2
PAGE_MARK = "<!-- page-break -->"
#: Texts and characters of a record batch of pages, about.
PAGE_TEXTS, PAGE_CHARS = 256, 1 << 20

_FENCE, _ROW = re.compile(r"\s*(```|~~~)"), re.compile(r"\s*\|")
_RULE = re.compile(r"(?=.*\|)(?=.*-)[|\-: \t]+$")


class Block(NamedTuple):
    start: int
    end: int
    header: int = 0  # where the header of a table ends, 0 for other blocks


class Piece(NamedTuple):
    start: int
    end: int
    header: str = ""  # a copy that stands before it


def blocks(text: str) -> list[Block]:
    """Paragraphs and tables in order; a fenced block is part of the paragraph that it touches, whatever its lines hold."""

    def lines() -> Iterator[tuple[str, int, int]]:
        at, fenced = 0, False
        for line in text.splitlines(keepends=True):
            bare = line.rstrip("\r\n")
            if _FENCE.match(bare):
                fenced = not fenced
            kind = "text" if fenced or (bare.strip() and not _ROW.match(bare)) else "row" if bare.strip() else "none"
            yield kind, at, at + len(bare)
            at += len(line)

    out = []
    for kind, group in groupby(lines(), key=lambda x: x[0]):
        spans = [(a, b) for _, a, b in group]
        if kind == "none":
            continue
        start, end = _stripped(text, spans[0][0], spans[-1][1])
        ruled = kind == "row" and len(spans) > 1 and _RULE.match(text[slice(*spans[1])].strip())
        out.append(Block(start, end, spans[1][1] if ruled and spans[1][1] <= end else 0))
    return out


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return end - len(part.lstrip()), start + len(part.rstrip())


class Cutter:
    """Cuts one text; target and overlap in tokens."""

    def __init__(self, text: str, target: int = TARGET, overlap: int = OVERLAP):
        self.text, self.meter = text, Meter(text)
        self.target = target if target > 0 else TARGET
        self.overlap = min(max(overlap, 0), self.target // 2)
        self.room = max(1, self.target - self.overlap)

    def forced(self, start: int, end: int, budget: int) -> list[int]:
        """Ends of parts of what no sentence divides: each as long as fits, back to a line end or a blank in its last fifth."""
        out = []
        while self.meter.tokens(start, end) > budget:
            cut = max(self.meter.reach(start, end - 1, budget), start + 1)
            tail = max(start + 1, cut - (cut - start) // 5)
            line, blank = self.text.rfind("\n", tail, cut), max(self.text.rfind(c, tail, cut) for c in " \t")
            start = (line if line >= 0 else blank if blank >= 0 else cut - 1) + 1
            out.append(start)
        return [*out, end] if start < end else out

    def paragraph(self, block: Block) -> list[Piece]:
        """A paragraph over budget in pieces of whole sentences, as long as fit."""
        ends, at = [], block.start
        for e in sentence_ends(self.text[block.start : block.end]):
            ends += self.forced(at, block.start + e, self.room)
            at = block.start + e
        out, start = [], block.start
        while start < block.end:
            k = bisect_right(ends, self.meter.reach(start, block.end, self.room))
            end = ends[k - 1] if k and ends[k - 1] > start else ends[k]
            out.append(Piece(start, end))
            start = end
        return out

    def table(self, block: Block) -> list[Piece]:
        """A table over budget in pieces of whole rows; all but the first begin with the header, if it's short enough."""
        rows, at = [], block.header
        for line in self.text[block.header : block.end].splitlines(keepends=True):
            bare = len(line.rstrip("\r\n"))
            if bare:
                rows.append((at, at + bare))
            at += len(line)
        if not rows:
            return [Piece(block.start, block.end)]
        size = self.meter.size(block.start, rows[0][0])
        cost = self.meter.tokens(block.start, rows[0][0])
        header = self.text[block.start : rows[0][0]] if cost * HEADER_SHARE <= self.room else ""
        size = size if header else (0, 0)
        units = []
        for a, b in rows:
            for end in self.forced(a, b, max(1, self.room - cost * bool(header))):
                units.append((a, end))
                a = end
        out, start, end, before = [], block.start, units[0][1], (0, 0)
        for a, b in units[1:]:
            if self.meter.tokens(start, b, before) > self.room:
                out.append(Piece(start, end, header if out else ""))
                start, before = a, size
            end = b
        return [*out, Piece(start, end, header if out else "")]

    def pieces(self) -> list[Piece]:
        out = []
        for b in blocks(self.text):
            fits = self.meter.tokens(b.start, b.end) <= self.room
            out += [Piece(b.start, b.end)] if fits else self.table(b) if b.header else self.paragraph(b)
        return out

    def overlapping(self, last: Piece, piece: Piece) -> int:
        """Where a chunk begins that goes on from the last one: at a sentence of its end, as early as overlap and target let it."""
        if piece.header or last.end > piece.start or not self.overlap or last.start == last.end:
            return piece.start
        ends = sentence_ends(self.text[last.start : last.end])
        starts, used = [], 0
        for a, b in reversed([*zip([0, *ends], ends)]):
            used += self.meter.tokens(last.start + a, last.start + b)
            if starts and used > self.overlap:
                break
            starts.append(last.start + a)
            if used >= self.overlap:
                break
        return next((s for s in reversed(starts) if self.meter.tokens(s, piece.end) <= self.target), piece.start)

    def chunks(self) -> list[Piece]:
        out: list[Piece] = []
        for piece in self.pieces():
            last = out[-1] if out else None
            if last and not piece.header:
                before = (len(last.header), Meter(last.header).size(0, len(last.header))[1]) if last.header else (0, 0)
                if self.meter.tokens(last.start, piece.end, before) <= (self.target if len(out) == 1 else self.room):
                    out[-1] = last._replace(end=piece.end)
                    continue
            out.append(piece._replace(start=self.overlapping(last, piece)) if last else piece)
        return [c for c in out if (c.header + self.text[c.start : c.end]).strip()]


SCHEMA = pa.schema([("ordinal", pa.int32()), ("content", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("heading_path", pa.string()), ("page", pa.int32()), ("token_count", pa.int32())])


def chunk_rows(text: str, target: int = TARGET, overlap: int = OVERLAP, page_mark: str = PAGE_MARK) -> list[tuple]:
    """Rows of SCHEMA for a text; offsets are those in the text without page marks (see pages())."""
    body, spans = pages(text, page_mark)
    paths = headings(body)
    at, first = [o for o, _ in paths], [a for _, a, _ in spans]
    rows = []
    cutter = Cutter(body, target, overlap)
    for c in cutter.chunks():
        content = c.header + body[c.start : c.end]
        k, p = bisect_right(at, c.start), bisect_right(first, c.start)
        rows.append((len(rows), content, c.start, c.end, paths[k - 1][1] if k else None, spans[p - 1][0] if p else None, cutter.meter.tokens(c.start, c.end, Meter(c.header).size(0, len(c.header)))))
    return rows


def chunk_documents(docs: DataFrame, key: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, content, char_start, char_end, heading_path, page, token_count) of each text, a null one as empty; a text's chunks are made where its row is."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a record batch for each text, so that a batch of long ones is never held twice
                rows = chunk_rows(batch.column(1)[i].as_py() or "", target, overlap)
                if rows:
                    own = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA))], names=[key, *SCHEMA.names])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ordinal int, content string, char_start int, char_end int, heading_path string, page int, token_count int")


def page_rows(docs: DataFrame, key: str, text: str, page_mark: str = PAGE_MARK) -> DataFrame:
    """(key, page, char_start, char_end, content) of each page of each text; offsets are those in the text without marks. A text's pages are made where its row is,
    in record batches of PAGE_TEXTS texts or some PAGE_CHARS characters, so that a worker never holds the pages of a whole batch."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "page", "char_start", "char_end", "content"]

    def run(batches):
        for batch in batches:
            own, rows, size = [], [], 0
            for i in range(batch.num_rows):
                body, spans = pages(batch.column(1)[i].as_py() or "", page_mark)
                rows += [(page, a, b, body[a:b]) for page, a, b in spans]
                own += [i] * len(spans)
                size += len(body)
                if size >= PAGE_CHARS or i + 1 == batch.num_rows or (i + 1) % PAGE_TEXTS == 0:
                    columns = [*zip(*rows)] or [()] * 4
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)
                    own, rows, size = [], [], 0

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, page int, char_start int, char_end int, content string")
