"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams (two and three code points of the lower-cased text, every run of other characters counted as
one space), weighted by log(1 + count) and by inverse document frequency, and brought to length 1. Each language has several
centroids from spherical k-means; the language of the nearest by cosine wins. A text whose cosine is less than its language asks for at its
length is rejected.

Document frequencies are counted over all training rows; the centroids and limits are fitted, one language to a group of a task, on a sample of at
most SAMPLE rows of each language, those of least hash of doc_id. Only centroids and limits (130 KB a language) come to the driver.

Cases: null text and text without a letter are ``und`` with score 0, rejected and never learned from; a null lang is never learned from; a null doc_id is
neither learned from nor held out; equal texts get equal predictions (ties go to the first language in order); with nothing to learn from, all
is ``und``; an empty table gives no rows; columns beyond doc_id, text and lang are ignored by identify() and kept by keep_known().
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, lean, lean_group, table

HASH_BITS = 13
DIMENSIONS = 1 << HASH_BITS
SAMPLE = 600
CENTROIDS, ROUNDS = 4, 12
#: Texts whose vectors are held at a time.
ROWS = 256
#: Lengths fall into classes by the power of two of their number of n-grams. A limit is a share of a low quantile of the cosines that the sample rows of a
#: language of that length, or of the lengths beside it, have to their centroids; with fewer than LEAST_ROWS of them all rows of the language count.
LENGTHS, LIMIT_SHARE, LIMIT_QUANTILE, LEAST_ROWS = 24, 0.7, 0.01, 20
#: Code points whose n-grams are counted at a time; a longer text is counted in pieces that overlap.
BLOCK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of what is no letter as one 0, with a 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[0], np.where(_letters()[np.minimum(codes, 0x10FFFF)], codes, 0), [0]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def vectors(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams: a row of DIMENSIONS for each text; all 0 for one without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    held: list[tuple[int, np.ndarray, bool]] = []
    size = 0
    for k, text in enumerate(texts):
        codes = _codes(text)
        for i in range(0, len(codes), BLOCK):
            held.append((k, codes[max(0, i - 2) : i + BLOCK], i > 0))
            size += len(held[-1][1])
            if size >= BLOCK:
                _count(held, out)
                held, size = [], 0
    if held:
        _count(held, out)
    return out


def _count(held: list[tuple[int, np.ndarray, bool]], out: np.ndarray) -> None:
    """Add the n-grams of pieces of texts, given with their rows; one that goes on repeats the last two code points of the piece before."""
    first = held[0][0]
    codes = np.concatenate([c for _, c, _ in held])
    row = np.repeat(np.array([k - first for k, _, _ in held]), [len(c) for _, c, _ in held])
    piece = np.repeat(np.arange(len(held)), [len(c) for _, c, _ in held])
    starts = np.cumsum([0, *(len(c) for _, c, _ in held)])[:-1]
    again = starts[[more for _, _, more in held]]
    rows = held[-1][0] - first + 1
    for n in (2, 3):
        h = np.zeros(max(0, len(codes) - n + 1), np.uint32)
        some = np.zeros(len(h), bool)
        for i in range(n):
            part = codes[i : len(h) + i]
            h = h * np.uint32(2654435761) + part * np.uint32(40503) + np.uint32(n)
            some |= part != 0
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(2246822519)) >> np.uint32(32 - HASH_BITS)
        some &= piece[: len(h)] == piece[n - 1 :]
        if n == 2:
            some[again[again < len(some)]] = False
        out[first : first + rows] += np.bincount(row[: len(h)][some] * DIMENSIONS + h[some], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from spread rows: centroids of length 1."""
    first = [int(np.argmax(x @ x.mean(0)))]
    for _ in range(1, min(k, len(x))):
        first.append(int(np.argmin((x @ x[first].T).max(1))))
    centre = x[first]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        centre = np.stack([x[own == i].sum(0) if (own == i).any() else centre[i] for i in range(len(centre))])
        centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(1) + 1).astype(int), LENGTHS - 1)


def limits(cosines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least cosine that a text of each length class needs; never less than that of shorter texts."""
    out = []
    for k in range(LENGTHS):
        some = cosines[np.abs(lengths - k) <= 1]
        out.append(LIMIT_SHARE * np.quantile(some if len(some) >= LEAST_ROWS else cosines, LIMIT_QUANTILE))
    return np.maximum.accumulate(out)


def _document_frequency(batches):
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            found = vectors(batch.column(0).slice(i, ROWS).to_pylist()) > 0
            total += found.sum(0)
            n += int(found.any(1).sum())
    yield pa.RecordBatch.from_pydict({"slot": np.arange(DIMENSIONS + 1), "docs": np.append(total, n)})


def _fitted(idf: np.ndarray):
    """A language's centroids and limits as bytes, from its sample rows (lang, text)."""

    def run(group: pa.Table) -> pa.Table:
        counts = np.concatenate([vectors(group["text"].slice(i, ROWS).to_pylist()) for i in range(0, group.num_rows, ROWS)])
        counts = counts[np.lexsort(counts.T[:8])]  # equal results however the rows lie
        x = weigh(counts, idf)
        centre = cluster(x)
        low = limits((x @ centre.T).max(1), length_class(counts))
        return pa.table({"lang": group["lang"].slice(0, 1), "centres": [centre.astype("<f4").tobytes()], "limits": [low.astype("<f4").tobytes()]})

    return run


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(train: DataFrame) -> dict | None:
    """The model from rows (doc_id, text, lang), all with text and lang; None if no row has a letter."""
    sums = train.select("text").mapInArrow(lean(_document_frequency), "slot long, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).orderBy("slot").collect()
    if not sums or not (n := sums[-1]["docs"]):
        return None
    idf = (np.log((1 + n) / (1 + np.array([r["docs"] for r in sums[:-1]]))) + 1).astype(np.float32)
    # a first cut by each language's share of rows keeps what is sorted small
    part = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    shares = few(train.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), 1.5 * SAMPLE / F.col("n")).alias("share")))
    some = train.join(shares, "lang").withColumn("part", part).filter((F.col("part") <= F.col("share")) & F.col("text").rlike(r"\p{L}"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("part", "doc_id", "text"))).filter(F.col("k") <= SAMPLE)
    rows = some.select("lang", "text").groupBy("lang").applyInArrow(lean_group(_fitted(idf)), "lang string, centres binary, limits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["lang"])
    centres = [np.frombuffer(r["centres"], "<f4").reshape(-1, DIMENSIONS) for r in rows]
    low = np.stack([np.frombuffer(r["limits"], "<f4") for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(c) for c in centres])
    return {"idf": idf, "langs": [r["lang"] for r in rows], "of": of, "centres": np.concatenate(centres), "limits": low}


def nearest(model: dict | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, of each text."""
    if not model or not texts:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    counts = vectors(texts)
    near = weigh(counts, model["idf"]) @ model["centres"].T
    best = near.argmax(1)
    some = counts.any(1)
    score = np.where(some, np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(float)
    own = model["of"][best]
    reject = ~some | (score < model["limits"][own, length_class(counts)])
    return [model["langs"][k] if s else "und" for k, s in zip(own, some, strict=True)], score, reject


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) from docs(doc_id, held_out, text), all of it from text alone."""

    def run(batches):
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), ROWS):
                part = batch.slice(i, ROWS)
                lang, score, reject = nearest(model, [t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))


def identify(docs: DataFrame) -> DataFrame:
    model = fit(training_rows(docs))
    held = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    return predict(held, model)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs that the method doesn't reject, with all their columns."""
    model = fit(training_rows(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), ROWS):
                part = batch.slice(i, ROWS)
                yield part.filter(pa.array(~nearest(model, [t or "" for t in part.column(at).to_pylist()])[2]))

    return docs.mapInArrow(lean(run), docs.schema)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
