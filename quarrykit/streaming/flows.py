"""Structured Streaming: depths of an ingest queue, alerts in sliding windows, confidence and citation markers with state by key."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import ARCHIVE_BELOW, DELTAS, START


def ingest_depth(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Per key: rows waiting and running, and the newest status; for a stream in complete or update mode, or for a table."""
    return events.groupBy(key).agg(F.count_if(F.col(status) == "waiting").alias("waiting"), F.count_if(F.col(status) == "running").alias("running"), F.max_by(status, at).alias("last_status"))


def alert_windows(calls: DataFrame, at: str, key: str, failed, late: str = "10 minutes", length: str = "30 minutes", every: str = "10 minutes") -> DataFrame:
    """Failures and calls of each key in sliding windows that have a failure; rows that come later than ``late`` are left out."""
    w = calls.withWatermark(at, late).groupBy(F.window(at, length, every), key).agg(F.count_if(failed).alias("failures"), F.count("*").alias("calls"))
    return w.filter("failures > 0").select(F.col("window.start").alias("start"), key, "failures", "calls")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class ConfidenceProcessor(StatefulProcessor):
    """Folds events(key, event, share) into a confidence that is kept by key; gives a row after each batch that touches it. A batch's events go by the column seq, if
    there is one, so that stream and table agree as long as batches come in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("confidence", "c double, n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        c, n = self.state.get() if self.state.exists() else (START, 0)
        batch = pd.concat([*rows])
        batch = batch.sort_values("seq", kind="stable") if "seq" in batch else batch
        for event, share in zip(batch["event"], batch["share"], strict=True):
            scale = share if event in ("positive_feedback", "negative_feedback") else 1.0
            c, n = min(1.0, max(0.0, c + DELTAS.get(event, 0.0) * scale)), n + 1
        self.state.update((c, n))
        yield pd.DataFrame({"key": [key[0]], "confidence": [c], "archived": [c < ARCHIVE_BELOW], "n": [n]})

    def close(self) -> None:
        pass


class MarkerProcessor(StatefulProcessor):
    """Takes citation markers out of answers that arrive in pieces(message, seq, piece); a marker cut in two waits in the state for its rest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "text string, length long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        tail, length = self.state.get() if self.state.exists() else ("", 0)
        pieces = pd.concat([*rows]).sort_values("seq")["piece"].tolist()
        found, plain, tail = take_markers(tail + "".join(pieces))
        self.state.update((tail, length + len(plain)))
        yield pd.DataFrame({"message": [key[0]] * len(found), "number": [n for n, _ in found], "char_offset": [length + o for _, o in found]}).astype({"number": "int64", "char_offset": "int64"})

    def close(self) -> None:
        pass


def take_markers(text: str) -> tuple[list[tuple[int, int]], str, str]:
    """(number, offset in the plain text) of whole markers, the plain text, and a tail that may be the start of a marker."""
    import re

    found, plain, at = [], "", 0
    for m in re.finditer(r"\[\^[a-z]?(\d+)\]", text):
        plain += text[at : m.start()]
        found.append((int(m[1]), len(plain)))
        at = m.end()
    rest = text[at:]
    cut = re.search(r"\[(?:\^(?:[a-z]?\d*)?)?\Z", rest)
    return found, plain + (rest[: cut.start()] if cut else rest), rest[cut.start() :] if cut else ""
