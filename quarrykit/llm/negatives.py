"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the rows of other labels whose score lies in a window below.

Candidates are put in order by label and along a Hilbert curve over their HILBERT_DIMS widest dimensions, and written as Parquet rows of one block of BLOCK
vectors each, beside a zone map: the least and the greatest value of each dimension and of the labels. For an anchor, interval arithmetic over the zone
gives the least and the greatest score that the block can hold; a block is read for a window only if these and its labels meet the window and what
is known of its last place. That is told first from a SEED-th of the blocks, then from the blocks that a task has read. All bounds are exact: every row
that belongs to a result is found, whatever the order.

Anchors are a stated query set. They go to the tasks in parts of some ANCHORS, so that what is sent and what the driver holds (places of positives and
last scores of windows, for one part at a time) does not grow with the data; each part reads the blocks anew.

Cases: rows with a null id, label or vector, or a component that is null or not finite, take no part, nor do vectors of another length than most
have (of lengths as frequent the longest); of rows that share an id the one of the smallest label, then vector, stays; ties in score go by the smaller id; anchors without
another row of their label give no rows; an empty table gives none. Products must fit in a long: beyond, OverflowError is raised. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Vectors of a block; dimensions and bits of each in the curve; a SEED-th of blocks is read first; anchors sent at once; rows held before they are cut to the first k.
BLOCK, HILBERT_DIMS, HILBERT_BITS, SEED, ANCHORS, HELD = 256, 8, 6, 16, 1 << 14, 1 << 18
#: Positives of an anchor, negatives of a pair, the window in percent of the positive's score, the factor of components, what divides anchors' and odd labels' ids.
POSITIVES, NEGATIVES, WINDOW, SCALE, ANCHOR_STEP, LABEL_STEP, LABELS = 5, 10, (30, 90), 256, 100, 7, 10
LEAST, MOST = -(1 << 62), 1 << 62


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of cells, whole numbers of ``bits`` bits in each dimension, as a whole number."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrorings of each level
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(set_, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b) & 1
    return out


def clean(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; vector holds whole numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # conditions stand one in the other, so that none is computed on what an earlier one leaves out
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.when(F.col("embedding").isNull(), False).otherwise(~F.exists("embedding", odd)))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    good = good.join(F.broadcast(sizes.select("d")), F.size("embedding") == F.col("d"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    good = good.select("vec_id", F.col("label").cast("long").alias("label"), whole.alias("vector"))
    return good.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select(F.col("vec_id").cast("long").alias("vec_id"), "r.*")


def _keys(dims: list[int], mean: list[float], spread: list[float]):
    def run(batches):
        for batch in batches:
            v = batch.column(2)
            vectors = v.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1 + max(dims, default=0)), np.int64)
            half = 1 << (HILBERT_BITS - 1)
            cells = np.clip(np.floor((vectors[:, dims] - np.array(mean)) / np.array(spread) * (half / 3)) + half, 0, 2 * half - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, HILBERT_BITS))], names=["vec_id", "label", "vector", "place"])

    return run


BLOCK_ROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("label_low", pa.int64()), ("label_high", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])


def _cut(batches):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def block(ids, labels, vectors):
        low, high = (f(axis=0).astype("<i8").tobytes() for f in (vectors.min, vectors.max))
        row = [int(ids.min()), len(ids), int(labels.min()), int(labels.max()), low, high, *(x.astype("<i8").tobytes() for x in (ids, labels, vectors))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK_ROW, strict=True)], schema=BLOCK_ROW)

    def joined():
        return [np.concatenate([h[i] for h in held]) for i in range(3)]

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)))
            size += batch.num_rows
        if size >= BLOCK:
            ids, labels, vectors = joined()
            whole = size // BLOCK * BLOCK
            for s in range(0, whole, BLOCK):
                yield block(ids[s : s + BLOCK], labels[s : s + BLOCK], vectors[s : s + BLOCK])
            held, size = [(ids[whole:], labels[whole:], vectors[whole:])], size - whole
    if size:
        yield block(*joined())


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows(vec_id, label, vector) in the order of the curve, each a row with its zone map."""
    d = (rows.select(F.size("vector").alias("d")).head() or [0])[0]
    stats = rows.agg(*(f(F.col("vector")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if d else None
    dims = sorted(range(d), key=lambda i: (-(stats[f"s{i}"] or 0), i))[:HILBERT_DIMS]
    run = _keys(dims, [stats[f"m{i}"] for i in dims], [stats[f"s{i}"] or 1.0 for i in dims]) if d else _keys([0], [0.0], [1.0])
    placed = rows.mapInArrow(run, "vec_id long, label long, vector array<long>, place long") if d else rows.limit(0).withColumn("place", F.lit(0).cast("long"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, "label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")
    kinds = "block long, n int, label_low long, label_high long, low binary, high binary, ids binary, labels binary, vectors binary"
    return materialize(ordered.select("vec_id", "label", "vector").mapInArrow(_cut, kinds))


class Anchors:
    """A part of the anchors, and for each of them windows of scores: owner is the anchor of a window, from and to its ends, least what must be reached."""

    def __init__(self, ids, labels, vectors, owner=None, start=None, end=None):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        n = len(ids)
        self.owner = np.arange(n) if owner is None else owner
        self.start = np.full(len(self.owner), LEAST) if start is None else start
        self.end = np.full(len(self.owner), MOST) if end is None else end
        self.least = np.full(len(self.owner), LEAST)
        self.up, self.down = np.maximum(vectors, 0), np.minimum(vectors, 0)

    def zone(self, low: np.ndarray, high: np.ndarray):
        """The least and the greatest score of each anchor with any vector between low and high."""
        return product(self.up, low) + product(self.down, high), product(self.up, high) + product(self.down, low)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b (a vector, or vectors in columns) in whole numbers: floating point where all sums are exact in it."""
    size = (float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)), a.shape[1])
    if size[0] * size[1] * size[2] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if size[0] * size[1] * size[2] >= 2**62:
        raise OverflowError("scores don't fit in a long")
    return a @ b


class Tops:
    """The first k of (window, score, id) by score, then smaller id."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.size = k, floor, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, window, score, ids) -> None:
        self.parts.append((window, score, ids))
        self.size += len(window)
        if self.size > HELD + self.k * len(self.floor):
            self.cut()

    def cut(self):
        window, score, ids = (np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)]) for i in range(3))
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        begins = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
        rank = np.arange(len(window)) - np.repeat(begins, np.diff(np.r_[begins, len(window)]))
        last = rank == self.k - 1
        self.floor[window[last]] = np.maximum(self.floor[window[last]], score[last])
        keep = rank < self.k
        self.parts = [(window[keep], score[keep], ids[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _search(sent, same: bool, k: int):
    """Reads the blocks that windows ask for, and gives (window, score, id) of the first k of each window in this task."""

    def run(batches):
        a: Anchors = sent.value
        tops = Tops(k, a.least.copy())
        by_anchor = np.argsort(a.owner, kind="stable")
        first = np.searchsorted(a.owner[by_anchor], np.arange(len(a.ids) + 1))
        for batch in batches:
            for row in batch.to_pylist():
                low, high = (np.frombuffer(row[c], "<i8") for c in ("low", "high"))
                if same:
                    fits = (a.labels >= row["label_low"]) & (a.labels <= row["label_high"])
                else:
                    fits = (a.labels != row["label_low"]) | (a.labels != row["label_high"])
                least, most = a.zone(low, high)
                open_ = fits[a.owner] & (most[a.owner] >= np.maximum(a.start, tops.floor)) & (least[a.owner] <= a.end)
                if not open_.any():
                    continue
                ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1)
                reads = np.unique(a.owner[open_])
                for s in range(0, len(reads), 1 << 10):
                    own = reads[s : s + (1 << 10)]
                    scores = product(a.vectors[own], vectors.T)
                    meets = (labels[None, :] == a.labels[own][:, None]) == same
                    if same:
                        meets &= ids[None, :] != a.ids[own][:, None]
                    each = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
                    windows = by_anchor[np.concatenate([np.arange(first[o], first[o + 1]) for o in own])]
                    keep = open_[windows]
                    each, windows = each[keep], windows[keep]
                    near = scores[each]
                    hit = meets[each] & (near >= np.maximum(a.start, tops.floor)[windows][:, None]) & (near <= a.end[windows][:, None])
                    w, c = np.nonzero(hit)
                    tops.add(windows[w], near[w, c], ids[c])
        window, score, ids = tops.cut()
        for s in range(0, len(window), 1 << 16):
            e = s + (1 << 16)
            columns = [window[s:e], score[s:e], ids[s:e]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["window", "score", "id"])

    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _found(kept: DataFrame, anchors: Anchors, same: bool, k: int) -> DataFrame:
    """(window, score, id, rank) of the first k of each window. A SEED-th of the blocks tells what a row must reach before the others are read."""
    context = kept.sparkSession.sparkContext
    seeds = F.pmod(F.xxhash64("block"), F.lit(SEED)) == 0
    search = lambda part: part.mapInArrow(_search(context.broadcast(anchors), same, k), "window long, score long, id long")
    some = materialize(_first(search(kept.filter(seeds)), k))
    last = some.filter(F.col("rank") == k).select("window", "score").toArrow()  # one row for each window of this part of the anchors
    anchors.least[last["window"].to_numpy()] = last["score"].to_numpy()
    return _first(some.drop("rank").unionByName(search(kept.filter(~seeds))), k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, label, vector), whole numbers; window gives the least and the
    greatest score of a negative in percent of the positive's."""
    spark = rows.sparkSession
    rows = materialize(rows)
    kept = blocks(rows)
    anchors = rows.filter(is_anchor)
    parts = -(-anchors.count() // ANCHORS)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        some = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow()
        if not some.num_rows:
            continue
        ids, labels = (some[c].to_numpy() for c in ("vec_id", "label"))
        vectors = some["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        near = _found(kept, Anchors(ids, labels, vectors), True, positives).toArrow()
        owner, score = near["window"].to_numpy(), near["score"].to_numpy()
        start, end = -((-window[0] * score) // 100), window[1] * score // 100
        pairs = Anchors(ids, labels, vectors, owner, start, end)
        found = _found(kept, pairs, False, negatives)
        names = pa.table({"window": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": near["id"], "positive_score": score})
        told = spark.createDataFrame(names.cast(pa.schema([(c, pa.int64()) for c in names.column_names])))
        out = out.unionByName(materialize(found.join(F.broadcast(told), "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Negatives of the anchors, rows whose vec_id is divisible by ANCHOR_STEP; labels of ids divisible by LABEL_STEP are moved by one first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % LABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(clean(rows.withColumn("label", moved)), F.col("vec_id") % ANCHOR_STEP == 0)
