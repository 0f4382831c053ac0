"""Citations of answers that arrive in pieces: markers are taken out of the text wherever a piece ends, and each known one is told once with its place.

The same steps run over a table (cited) and over a stream (CitationProcessor, for transformWithStateInPandas in event time).
"""

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.groups import along_groups

MARKER = re.compile(r"\[\^([A-Za-z]?)([0-9]+)\]")
_BEGUN = re.compile(r"\[(?:\^(?:[A-Za-z]?[0-9]*)?)?\Z")
#: Milliseconds of event time after a message's last piece until what is held of it is let go as plain text.
HOLD_MS = 60_000


def feed(text: str, known: set[str]) -> tuple[str, list[tuple[str, int]], str]:
    """The plain text, (marker, offset in it) of each marker, and a tail that may be the beginning of one. A marker without a letter counts if c and its number are
    known; any letter stands for c."""
    found: list[tuple[str, int]] = []
    plain, at = "", 0
    for m in MARKER.finditer(text):
        if m[1] or f"c{m[2]}" in known:
            plain += text[at : m.start()]
            found.append((f"c{m[2]}", len(plain)))
            at = m.end()
    rest = text[at:]
    cut = _BEGUN.search(rest)
    end = cut.start() if cut else len(rest)
    return plain + rest[:end], found, rest[end:]


class Reader:
    """What is kept of a message between its pieces."""

    def __init__(self, state: str | None = None):
        held = json.loads(state) if state else {}
        self.tail, self.length = held.get("tail", ""), held.get("length", 0)
        self.known, self.told = set(held.get("known", [])), list(held.get("told", []))

    def state(self) -> str:
        return json.dumps({"tail": self.tail, "length": self.length, "known": sorted(self.known), "told": self.told})

    def take(self, piece: str | None, known) -> tuple[str, list[tuple[str, int]]]:
        """The text that a piece lets out, and the markers told for the first time; markers that are not known go without a trace."""
        self.known |= set(known) if known is not None else set()
        if not piece:
            return "", []
        text, found, self.tail = feed(self.tail + piece, self.known)
        new = []
        for marker, offset in found:
            if marker in self.known and marker not in self.told:
                self.told.append(marker)
                new.append((marker, self.length + offset))
        self.length += len(text)
        return text, new

    def flush(self) -> str:
        text, self.tail = self.tail, ""
        self.length += len(text)
        return text


def cited(pieces: DataFrame, key: str = "message") -> DataFrame:
    """(key, marker, char_offset, text) of pieces(key, seq, piece, known): each citation of a message, in order, and its whole plain text."""
    kind = pieces.schema[key].dataType.simpleString()

    def step(rows):
        r = Reader()
        text, found = "", []
        for row in rows:
            more, new = r.take(row["piece"], row["known"])
            text += more
            found += new
        text += r.flush()
        return [{key: rows[0][key], "marker": m, "char_offset": o, "text": text} for m, o in found]

    return along_groups(pieces.select(key, "seq", "piece", "known"), [key], ["seq"], step, f"{key} {kind}, marker string, char_offset int, text string")


class CitationProcessor(StatefulProcessor):
    """Rows (message, seq, at, piece, known) of one message; gives (message, text, marker, char_offset), text or a marker in each row. Pieces of a batch go by seq; a
    piece later than the watermark is not seen. A message that stays silent for HOLD_MS lets its tail out and is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("message", "state string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        reader = Reader(self.held.get()[0] if self.held.exists() else None)
        out, last = [], 0
        batch = pd.concat([*rows]).sort_values("seq", kind="stable")
        for piece, known, at in zip(batch["piece"], batch["known"], batch["at"], strict=True):
            text, found = reader.take(None if pd.isna(piece) else piece, known)
            out += [(text, None, None)] * bool(text) + [(None, m, o) for m, o in found]
            last = max(last, int(at.timestamp() * 1000))
        self.held.update((reader.state(),))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + HOLD_MS)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        text = Reader(self.held.get()[0] if self.held.exists() else None).flush()
        self.held.clear()
        yield self._rows(key, [(text, None, None)] if text else [])

    @staticmethod
    def _rows(key, rows) -> pd.DataFrame:
        out = pd.DataFrame({"message": [key[0]] * len(rows), "text": [r[0] for r in rows], "marker": [r[1] for r in rows], "char_offset": pd.array([r[2] for r in rows], "Int64")})
        return out.astype({"text": object, "marker": object})

    def close(self) -> None:
        pass
