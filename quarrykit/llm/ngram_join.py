"""Exact Jaccard join of documents' shingle sets by R-trees of count vectors.

Texts of equal sets form a class, and only classes are compared. Shingles are hashed into groups; a class is the point of its counts by group. The
overlap of two sets is at most the sum of the smaller of their counts, and at most that of a point and the largest counts of an R-tree node.

R-trees over all points at once would end in all pairs, since the boxes of short sets cover each other. So points are first dealt by the prefix
principle: two sets of the likeness asked for share one of their first shingles in any order of all shingles. Classes that share one form a block,
whose R-tree finds the pairs that sizes and 128 groups allow; what such pairs connect is a coarse component. In each of these R-trees over finer points,
with a group for each four to eight shingles of a set, find the pairs left, and what these connect is verified on the sets themselves. Order puts
shingles of large blocks last, so that a passage that many documents share is in few prefixes.

Components are passed to tiles (see connect()): small ones are packed, large ones are cut into parts by set size and hash. First each part connects
what it can alone, then one class of each connected piece stands for it; only classes that the largest piece of a component doesn't hold by then
are brought together with all other parts. So a large group of near copies is sent once, not once for each of its parts. A pair is passed over only
if what was found before connects it already, so components are exact. Sets and classes are compared by 64-bit hashes: of n shingles some two
differ by chance with a hash in common with a probability of n * n / 2**65, and a link is wrong only where that moves a likeness across the limit.

Cases: a text without words, or null, has an empty set and is linked with nothing; a null doc_id takes part, but names a component only if no other
member has an id (null then); rows that repeat are one class; an empty table gives no rows; columns beyond doc_id and text are ignored by
link() and kept by keep_first().
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, joined, lean, lean_group, materialize, table
from .components import connected_components, stars, tied
from .ngrams import mix, shingle_sets

SHINGLE, PERCENT = 4, 85
GROUP_BITS, FANOUT = 7, 32
GROUPS = 1 << GROUP_BITS
#: Shingles whose blocks hold more classes go last in the order, HEAVY_KEPT of the most frequent at most. Which these are is told, ORDERS times
#: at most, from the texts of one hash value in ORDER_RATE. All of it changes the order and so the work, never a result: any order finds every link.
HEAVY, HEAVY_KEPT, ORDERS, ORDER_RATE = 2000, 1 << 16, 2, 16
#: Classes of a part of a large block, and those of a block whose pairs are all bounded without a tree.
BLOCK_CLASSES, FEW = 2000, 8
#: Shingles of a part of a tile (8 bytes each when hashed), groups of fine points of a part (2 bytes each), and classes of either.
TILE_SHINGLES, TILE_POINTS, TILE_CLASSES = 1 << 20, 6 << 20, 6000
#: Counts that a step of a search holds against a point.
CELLS = 1 << 20
#: Bytes of texts hashed at a time, but for the text that passes them.
BLOCK = 1 << 20


def _blocks(batch: pa.RecordBatch, column: int):
    """(first row, texts as bytes) for runs of rows of a batch."""
    held, size, first = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= BLOCK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def class_key(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        both = mix(s).sum(dtype=np.uint64) + mix(mix(s * np.uint64(3) + np.uint64(len(s)))).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([both], np.uint64)).view(np.int64)[0])


def counts_of(s: np.ndarray) -> np.ndarray:
    """A set's point, for sets of fewer than 65,536 shingles in any group; larger counts of a group stand as 65,535 in either of two sets, and
    sets that have one are not bounded (see able())."""
    return np.minimum(np.bincount((s >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=GROUPS), 65535)


def fine_level(n: np.ndarray | int) -> np.ndarray | int:
    """Bits of the group numbers of a set of n shingles: four to eight shingles a group."""
    return np.clip(np.frexp(n)[1] - 3, 4, 20)


def fine_counts(s: np.ndarray) -> np.ndarray:
    level = int(fine_level(len(s)))
    return np.minimum(np.bincount((s >> np.uint64(64 - level)).astype(np.int64), minlength=1 << level), 65535)


def able(bound: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b shingles, of which at most ``bound`` are shared, can have the likeness asked for."""
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (((100 + percent) * bound >= percent * (a + b)) | (np.maximum(a, b) > 65535))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signatures(size: int, percent: int, heavy: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, texts in _blocks(batch, 2):
                keys, sizes, firsts, vectors, fine = [], [], [], [], []
                for s in shingle_sets(texts, size):
                    keys.append(class_key(s))
                    sizes.append(len(s))
                    vectors.append(counts_of(s).astype("<u2").tobytes())
                    fine.append(fine_counts(s).astype("<u2").tobytes())
                    k = prefix_length(len(s), percent) if len(s) else 0
                    if len(heavy) and k:
                        late = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                        s = np.concatenate([s[~late], s[late]]) if late.any() else s
                    firsts.append(s[:k].view(np.int64))
                flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(flat))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(vectors, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "row", "class", "n", "prefix", "counts", "fine"])

    return run


def signatures(docs: DataFrame, size: int, percent: int, heavy: list[int] = ()) -> DataFrame:
    """(doc_id, row, class, n, prefix, counts, fine) of every row; row is a hash of its text, counts and fine are 16-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    late = np.sort(np.array(heavy, np.int64).view(np.uint64))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(lean(_signatures(size, percent, late)), f"doc_id {kind}, row long, class long, n long, prefix array<long>, counts binary, fine binary")


class Tree:
    """An R-tree over points of counts, packed by size and then by the coordinate that varies most."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = FANOUT * FANOUT
        parts = []
        for i in range(0, len(order), slab):
            part = order[i : i + slab]
            parts.append(part[np.argsort(counts[part][:, counts[part].var(0).argmax()], kind="stable")])
        self.order = np.concatenate(parts)
        self.levels = []
        top, least, most = counts[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1 or not self.levels:
            at = np.arange(0, len(top), FANOUT)
            top, least, most = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((top, least, most))
        self.counts, self.sizes = counts[self.order], sizes[self.order]

    def near(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Places in order of the points whose set can have the likeness asked for with a set of n shingles at this point."""

        def kept(top, least, most, places):
            size = np.maximum(least[places], -(-percent * n // 100))
            places, size = places[size <= most[places]], size[size <= most[places]]
            step = max(1, CELLS // top.shape[1])
            bound = np.concatenate([np.minimum(top[places[i : i + step]], point).sum(1) for i in range(0, len(places), step)] or [size])
            ok = able(bound, np.full(len(size), n), size, percent)
            return places[ok | (most[places] > 65535)]

        places = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            places = kept(*self.levels[k], places)
            below = len(self.levels[k - 1][1]) if k else len(self.order)
            places = (places[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            places = places[places < below]
        return kept(self.counts, self.sizes, self.sizes, places)


def _joins(label: np.ndarray, x: int, y: int) -> None:
    """Give two pieces one label."""
    a, b = sorted((label[x], label[y]))
    label[label == b] = a


def links(keys: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between classes that connect whatever the likeness of percent connects, beyond what labels say is connected: no more than a tree of each piece."""
    sizes = np.array([len(s) for s in sets])
    counts = np.stack([counts_of(s) for s in sets]).astype(np.int32)
    tree = Tree(counts, sizes)
    order = tree.order
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    every = np.unique(np.concatenate(sets))
    local = np.empty(int(ends[-1]), np.int32)
    for i, a, b in zip(order.tolist(), starts.tolist(), ends.tolist(), strict=True):
        local[a:b] = np.searchsorted(every, sets[i])
    mark = np.zeros(len(every), bool)
    del every
    label = np.unique(labels[order], return_inverse=True)[1]
    out = []
    for x in range(len(order)):
        n = int(tree.sizes[x])
        ys = tree.near(tree.counts[x], n, percent)
        ys = ys[(ys > x) & (label[ys] != label[x])]
        if not len(ys):
            continue
        own = local[starts[x] : ends[x]]
        mark[own] = True
        for y in ys.tolist():
            if label[y] == label[x]:
                continue
            shared = int(np.count_nonzero(mark[local[starts[y] : ends[y]]]))
            if 100 * shared >= percent * (n + int(ends[y] - starts[y]) - shared):
                out.append((int(keys[order[x]]), int(keys[order[y]])))
                _joins(label, x, y)
        mark[own] = False
    return out


def fine_links(keys: np.ndarray, labels: np.ndarray, sizes: np.ndarray, points: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A tree of edges of what the pairs that sizes and fine points allow connect, beyond what labels say is connected."""
    label = np.unique(labels, return_inverse=True)[1]
    level = fine_level(sizes)
    out = []
    for k in np.unique(level).tolist():
        # sets that can be linked are of one level or of two that follow each other; the finer points are folded
        own = np.flatnonzero((level == k) | (level == k + 1))
        counts = np.zeros((len(own), 1 << k), np.int32)
        for i, j in enumerate(own.tolist()):
            point = np.frombuffer(points[j], "<u2")
            counts[i] = point if level[j] == k else point.reshape(-1, 2).sum(1, dtype=np.int64)
        tree = Tree(counts, sizes[own])
        del counts
        place = own[tree.order]
        for x in range(len(place)):
            ys = tree.near(tree.counts[x], int(tree.sizes[x]), percent)
            for y in ys[(ys > x) & (label[place[ys]] != label[place[x]])].tolist():
                if label[place[y]] != label[place[x]]:
                    out.append((int(keys[place[x]]), int(keys[place[y]])))
                    _joins(label, place[x], place[y])
    return out


def _block_pairs(percent: int):
    """From rows (block, class, n, counts), sorted by block, a tree of edges (a, b) of what the pairs that sizes and counts allow connect in each block."""

    def whole(rows: pa.Table) -> pa.RecordBatch:
        block, key, n = (rows.column(i).to_numpy() for i in range(3))
        counts = np.frombuffer(b"".join(rows.column(3).to_pylist()), "<u2").reshape(len(key), GROUPS)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        sizes = np.diff(np.append(starts, len(block)))
        found = []
        for m in range(2, FEW + 1):
            at = starts[sizes == m]
            for i in range(m):
                for j in range(i + 1, m):
                    for k in range(0, len(at), 4096):
                        x, y = at[k : k + 4096] + i, at[k : k + 4096] + j
                        x, y = (z[key[x] != key[y]] for z in (x, y))
                        ok = able(np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64), n[x], n[y], percent)
                        found.append(np.stack([key[x[ok]], key[y[ok]]], 1))
        for s, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            found.append(_connected(key[s : s + m], n[s : s + m], counts[s : s + m].astype(np.int32), percent))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            block = rows.column(0).to_numpy()
            cut = int(np.searchsorted(block, block[-1])) if len(block) else 0  # the last block may go on
            if cut:
                yield whole(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield whole(held.combine_chunks())

    return run


def _connected(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    tree = Tree(counts, sizes)
    keys = keys[tree.order]
    label = np.arange(len(keys))
    found = []
    for x in range(len(keys)):
        ys = tree.near(tree.counts[x], int(tree.sizes[x]), percent)
        for y in ys[(ys > x) & (label[ys] != label[x])]:
            if label[y] != label[x]:
                if keys[x] != keys[y]:
                    found.append((keys[x], keys[y]))
                _joins(label, x, y)
    return np.array(found, np.int64).reshape(-1, 2)


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    """The pairs found in a tile, contracted."""
    a, b = stars(*np.array(found, np.int64).reshape(-1, 2).T)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(size: int, percent: int):
    """A tile's links, from rows (class, label, text)."""

    def run(group: pa.Table) -> pa.Table:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in group.select(["class", "label", "text"]).to_batches():
            for first, texts in _blocks(batch, 2):
                part = batch.slice(first, len(texts))
                for key, label, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(texts, size), strict=True):
                    held.setdefault(key, (label, s))
        if len(held) < 2:
            return _edges([])
        return _edges(links(np.array([*held]), np.array([x for x, _ in held.values()]), [s for _, s in held.values()], percent))

    return run


def _bounded(percent: int):
    """A tile's edges by fine points, from rows (class, label, n, fine)."""

    def run(group: pa.Table) -> pa.Table:
        keys, labels, sizes = (group[c].to_numpy() for c in ("class", "label", "n"))
        return _edges(fine_links(keys, labels, sizes, group["fine"].to_pylist(), percent) if len(keys) > 1 else [])

    return run


def connect(members: DataFrame, payload, run, percent: int, most: int) -> DataFrame:
    """(node, component) of what run() connects among members(class, component, n, units), whose links all lie within a component.

    payload(tiles) adds to rows (class, label, tile) what run() reads of a tile, which holds about 2 * ``most`` units and 2 * TILE_CLASSES classes at most,
    but for a single class. Labels say what is connected already.
    """
    members = materialize(members.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")))
    sums = members.groupBy("component").agg(F.sum("units").alias("u"), F.count("*").alias("c"))
    fits = (F.col("u") <= most) & (F.col("c") <= TILE_CLASSES)
    total = sums.filter(fits).agg(F.sum("u").alias("u"), F.sum("c").alias("c")).first()
    bins = max(1, -(-(total["u"] or 0) // most), -(-(total["c"] or 0) // TILE_CLASSES))
    large = few(sums.filter(~fits).select("component", F.lit(True).alias("large")))
    some = large.count() > 0
    rows = members.join(large, "component", "left")
    parts = F.greatest(F.ceil(F.sum("units") / most), F.ceil(F.count("*") / TILE_CLASSES)).cast("int")
    cut = few(rows.filter("large").groupBy("component", "band").agg(parts.alias("parts")))
    rows = rows.join(cut, ["component", "band"], "left").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    alone = F.when(F.col("large"), F.xxhash64(F.lit("own"), "component", "band", "part")).otherwise(F.xxhash64(F.lit("bin"), F.pmod(F.xxhash64("component"), F.lit(bins))))
    found = lambda tiles: payload(tiles).groupBy("tile").applyInArrow(lean_group(run), "a long, b long")
    edges = found(rows.select("class", F.col("class").alias("label"), alone.alias("tile")))
    if not some:
        return connected_components(edges, contracted=True)
    rows = materialize(rows.filter("large").select("class", "component", "band", "part", "units"))
    out = connected_components(edges, contracted=True)
    # one class of each piece of a part stands for it; each tile sees two bands of sizes that follow each other
    stand = _labelled(rows, out).groupBy("component", "band", "part", "label").agg(F.min(F.struct("class", "units")).alias("r")).select("component", "band", "label", "r.class", "r.units")
    stand = materialize(stand.withColumn("low", F.explode(F.array(F.col("band") - 1, F.col("band")))))
    sizes = few(stand.groupBy("component", "low").agg(parts.alias("parts")))
    stand = stand.join(sizes, ["component", "low"])
    out = _grown(out, found(stand.select("class", "label", F.xxhash64(F.lit("stand"), "component", "low", F.pmod(F.xxhash64("class"), F.col("parts"))).alias("tile"))))
    return _grown(out, found(_rest(_labelled(rows, out), most)))


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    own = components.select(F.col("node").alias("class"), F.col("component").alias("label"))
    return rows.drop("label").join(own, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _grown(components: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(materialize(edges)))


def _rest(rows: DataFrame, most: int) -> DataFrame:
    """(class, label, tile) of tiles for rows(class, component, band, units, label) that bring all pairs of pieces of a component together but those within its largest piece."""
    pieces = materialize(rows.groupBy("component", "label").agg(F.sum("units").alias("u")))
    main = few(pieces.groupBy("component").agg(F.max(F.struct("u", "label")).alias("m"), F.count("*").alias("pieces")).filter("pieces > 1").select("component", F.col("m.label").alias("main")))
    rows = rows.join(main, "component").withColumn("rest", (F.col("label") != F.col("main")).cast("int"))
    parts = F.greatest(F.ceil(F.sum("units") / most), F.ceil(F.count("*") / TILE_CLASSES)).cast("int")
    # only bands next to one that has classes out of the largest piece
    counts = materialize(rows.groupBy("component", "band", "rest").agg(parts.alias("parts")))
    near = None
    for move in (-1, 0, 1):
        other = counts.select("component", (F.col("band") - move).alias("band"), F.lit(move).alias("move"), F.col("rest").alias("r"), F.col("parts").alias("p"))
        near = other if near is None else near.unionByName(other)
    near = few(near.groupBy("component", "band").agg(F.collect_list(F.struct("move", "r", "p")).alias("near")))
    own = few(counts)
    rows = rows.join(own, ["component", "band", "rest"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).join(near, ["component", "band"])
    mine = F.struct(F.col("band").alias("b"), F.col("rest").alias("r"), F.col("part").alias("i"))

    def tiles(x: Column) -> Column:
        def tile(i: Column) -> Column:
            other = F.struct((F.col("band") + x["move"]).alias("b"), x["r"].alias("r"), i.cast("int").alias("i"))
            return F.xxhash64(F.lit("rest"), F.col("component"), F.least(mine, other), F.greatest(mine, other))

        return F.when((F.col("rest") == 1) | (x["r"] == 1), F.transform(F.sequence(F.lit(0), x["p"] - 1), tile)).otherwise(F.expr("array()").cast("array<bigint>"))

    return rows.select("class", "label", F.explode(F.flatten(F.transform("near", tiles))).alias("tile"))


def _prefixes(own: DataFrame) -> DataFrame:
    """(class, t): the first shingles of each class."""
    return own.filter("n > 0").groupBy("class").agg(F.first("prefix").alias("prefix")).select("class", F.explode("prefix").alias("t"))


def late_shingles(docs: DataFrame, size: int, percent: int) -> list[int]:
    """The shingles that go last in the order, in ascending order."""
    some = docs.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")), F.lit(ORDER_RATE)) == 0)
    heavy: set[int] = set()
    for _ in range(ORDERS):
        tokens = _prefixes(signatures(some, size, percent, sorted(heavy)))
        large = tokens.groupBy("t").agg(F.count("*").alias("size")).filter(F.col("size") > HEAVY / ORDER_RATE).orderBy(F.desc("size"), "t").limit(HEAVY_KEPT)
        found = {r["t"] for r in large.collect()}
        if found <= heavy:
            break
        heavy |= found
    return sorted(heavy)


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) of every row of docs; component_id is the smallest doc_id reachable by links."""
    return _linked(docs, size, percent).select("doc_id", "row", "n_shingles", "component_id")


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """link() with first, whether a row is the first of its component by doc_id (nulls last) and text hash. Components are told apart by class, as those that
    differ may share a component_id, null or that of an id with two texts."""
    own = materialize(signatures(docs, size, percent, late_shingles(docs, size, percent)))
    sized = _prefixes(own).withColumn("size", F.count("*").over(Window.partitionBy("t")))
    blocks = materialize(sized.filter("size > 1"))
    classes = own.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    parts = F.ceil(F.col("size") / BLOCK_CLASSES).cast("int")
    part = F.pmod(F.xxhash64("class"), parts).cast("int")
    block = F.when(parts == 1, F.array("t")).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64("t", F.least(i, part), F.greatest(i, part))))
    cut = blocks.select("class", F.explode(block).alias("block")).join(classes, "class").select("block", "class", "n", "counts")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cut.repartition(tasks, "block").sortWithinPartitions("block", "class").mapInArrow(lean(tied(_block_pairs(percent))), "a long, b long")
    exact = _verify(docs, own, _refine(own, connected_components(near, contracted=True), percent), size, percent)
    rows = own.select("doc_id", "row", "class", "n").join(exact.select(F.col("node").alias("class"), "component"), "class", "left")
    rows = materialize(rows.select("doc_id", "row", "n", F.coalesce("component", "class").alias("c")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    heads = rows.filter("n > 0").groupBy("c").agg(first.alias("head"), F.count("*").alias("times"))
    out = joined(rows, heads, ["c"], rows.count())
    empty = F.col("n") == 0
    is_first = empty | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row") == F.col("head.row")))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), is_first.alias("first"))


def _members(own: DataFrame, components: DataFrame, units: Column) -> DataFrame:
    sizes = own.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"))
    return sizes.join(components.select(F.col("node").alias("class"), "component"), "class").withColumn("units", units)


def _refine(own: DataFrame, coarse: DataFrame, percent: int) -> DataFrame:
    """Components of what fine points connect within coarse ones."""
    points = own.filter("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    return connect(_members(own, coarse, F.col("n") / 4), lambda tiles: points.join(tiles, "class"), _bounded(percent), percent, TILE_POINTS)


def _verify(docs: DataFrame, own: DataFrame, coarse: DataFrame, size: int, percent: int) -> DataFrame:
    """Components of the sets that are as like as asked for, within coarse ones."""
    members = materialize(_members(own, coarse, F.col("n")))
    # one text of each class; the same row twice is told apart by class within a tile
    one = own.join(members.select("class"), "class").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("class", F.col("r.doc_id").alias("r_doc"), F.col("r.row").alias("r_row"))
    one = few(one)
    text = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    texts = texts.join(one, (texts["row"] == one["r_row"]) & texts["doc_id"].eqNullSafe(one["r_doc"])).select("class", "text")
    return connect(members, lambda tiles: texts.join(tiles, "class").select("tile", "class", "label", "text"), _verified(size, percent), percent, TILE_SHINGLES)


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of docs, that of the smallest doc_id and then of the least text hash; rows without words stay, one for each doc_id
    and text. All columns are kept; of rows that repeat doc_id and text any one may stay. Only keys of rows that go are brought to the texts."""
    own = materialize(_linked(docs, size, percent))
    gone = few(own.filter(~F.col("first")).select(F.col("doc_id").alias("id"), F.col("row").alias("hash")).distinct())
    twice = few(own.filter("first").groupBy(F.col("doc_id").alias("id"), F.col("row").alias("hash")).count().filter("count > 1").drop("count"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    named = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    same = (F.col("own_hash") == F.col("hash")) & F.col("own_id").eqNullSafe(F.col("id"))
    kept = named.join(gone, same, "left_anti")
    once = kept.join(twice, same, "left_anti").select("whole")
    again = kept.join(twice, same, "left_semi").dropDuplicates(["own_id", "own_hash"]).select("whole")
    return once.unionByName(again).select("whole.*")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).drop("row")
