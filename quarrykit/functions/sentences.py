"""Sentences, token estimates and headings of one text: small rules that run inside Arrow batches."""

import functools
import re

import numpy as np

#: Characters that end a sentence by themselves, those that do before white space or the end, those that belong to the sentence before.
ENDS, ENDS_BEFORE_SPACE, CLOSERS = "。！？；", ".!?", "」』】）〕》”’\"'"
#: Code points of one token each: for prompts, and for chunks (fixed ranges).
WIDE_PROMPT, WIDE_CHUNK = ((0x4E00, 0x9FFF),), ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))

_END = re.compile(rf"(?:[\n{ENDS}]|[{ENDS_BEFORE_SPACE}](?=\s|\Z))[\n{CLOSERS}]*")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(```|~~~)")


def sentence_ends(text: str) -> list[int]:
    """Where each sentence ends; they join to the text again."""
    out = [m.end() for m in _END.finditer(text)]
    return out if not text or (out and out[-1] == len(text)) else [*out, len(text)]


def sentences(text: str) -> list[str]:
    ends = sentence_ends(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


@functools.cache
def _wide(ranges) -> np.ndarray:
    """Whether each code point lies in one of the ranges."""
    out = np.zeros(0x110000, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


class Meter:
    """Estimated tokens of any part of a text from sums over its characters: one for each wide character, one for every four of the others, rounded up."""

    def __init__(self, text: str, ranges=WIDE_CHUNK):
        if text.isascii():
            self.wide = None
            return
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.wide = np.zeros(len(code) + 1, np.int64)
        np.cumsum(_wide(ranges)[code], out=self.wide[1:])

    def tokens(self, start: int, end: int, before: tuple[int, int] = (0, 0)) -> int:
        """Of text[start:end], after ``before`` (characters, wide ones) that stand before it."""
        wide = (int(self.wide[end] - self.wide[start]) if self.wide is not None else 0) + before[1]
        return wide - (-(end - start + before[0] - wide) // 4)

    def size(self, start: int, end: int) -> tuple[int, int]:
        return end - start, int(self.wide[end] - self.wide[start]) if self.wide is not None else 0

    def reach(self, start: int, end: int, budget: int, before: tuple[int, int] = (0, 0)) -> int:
        """The largest place up to end for which text[start:place] holds no more than budget tokens; start if none does."""
        low, high = start, end
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.tokens(start, middle, before) <= budget else (low, middle - 1)
        return low


def estimate(text: str, ranges=WIDE_PROMPT) -> int:
    wide = int(_wide(ranges)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum()) if not text.isascii() else 0
    return wide - (-(len(text) - wide) // 4)


def headings(text: str) -> list[tuple[int, str]]:
    """(offset, path) of each heading outside of fences; a path is the open headings joined by ' > '."""
    out, open_, at, fenced = [], [], 0, False
    for line in text.splitlines(keepends=True):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(line.rstrip("\n"))):
            open_ = [h for h in open_ if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            out.append((at, " > ".join(t for _, t in open_ if t)))
        at += len(line)
    return out


def pages(text: str, mark: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without page marks and outer white space, with line ends as \\n, and (page, start, end) of each page that has any of it."""
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split(mark)
    whole = "".join(parts)
    body = whole.strip()
    lead = len(whole) - len(whole.lstrip())
    ends = np.clip(np.cumsum([len(p) for p in parts]) - lead, 0, len(body)).tolist()
    return body, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends), 1) if a < b]
