"""Texts whose character 4-grams overlap: all pairs, found by counting shared grams in tiles of (texts, texts), 64 texts a word."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NGRAM, normalized
from ..sources.stage import staged

#: Sets of the posting lists of a tile, and grams in them; tiles at least; words counted at a time.
BLOCK, GRAMS, TILES, CELLS = 1 << 15, 1 << 24, 64, 1 << 17
#: Grams that have a bit in more than this part of a tile's words have a row of words.
DENSE = 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Buckets of hashed grams by whose counts grams are put in order of rarity.
BUCKETS = 1 << 18
#: Sets of up to so many grams go whole to each tile.
WHOLE = 64


def gram_hashes(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the character 4-grams of a text, in order; a shorter text is its own only one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < NGRAM:
        code = np.append(code, np.full(NGRAM - len(code), 0x110000, np.uint64))  # no character
    x = (code[:-3] << np.uint64(42) | code[1:-2] << np.uint64(21) | code[2:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ code[3:] * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ x >> np.uint64(29))


def _sets(batches):
    """(id, n, g) of rows (id, text): the number of grams and their hashes; -1 and null for null text."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            g = [None if t is None else gram_hashes(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([-1 if x is None else len(x) for x in g], pa.int32()), pa.array([None if x is None else x.tobytes() for x in g], pa.binary())], names=["id", "n", "g"])


def _hashes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def _bucket_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount((_hashes(batch.column(0)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": at, "f": total[at]})


def _missing(n, threshold: float):
    """How many of n grams a set may lack that holds more than threshold of them (one more, for rounding)."""
    return n - np.floor(n * threshold).astype(np.int64)


def _rarest(sent, threshold: float):
    """Rows (a, h, n, g) with only as many of the rarest grams as tell most of the sets that can't hold enough of them."""

    def run(batches):
        f = sent.value
        for batch in batches:
            out = []
            for n, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, m = np.frombuffer(g, np.uint64), int(_missing(n, threshold))
                p = n if n <= WHOLE else min(n, m + max(16, m // 2 + 8))
                out.append(x[np.argsort(f[(x % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")[:p]].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["a", "h", "n", "g"])

    return run


def _bit_counts(rows: np.ndarray) -> list[np.ndarray]:
    """How many of the rows (rows, ..., words) have each bit set, as planes of binary digits from the lowest on; rows are overwritten."""
    planes = []
    while len(rows):
        n, at = len(rows), 0
        carries = np.empty((n // 2, *rows.shape[1:]), np.uint64)
        while n >= 3:
            t = n // 3
            a, b, c, carry = rows[:t], rows[t : 2 * t], rows[2 * t : 3 * t], carries[at : at + t]
            one = a ^ b
            np.bitwise_and(a, b, out=carry)
            np.bitwise_xor(one, c, out=a)
            one &= c
            carry |= one
            rows[t : n - 2 * t] = rows[3 * t : n]
            n, at = n - 2 * t, at + t
        if n == 2:
            np.bitwise_and(rows[0], rows[1], out=carries[at])
            rows[0] ^= rows[1]
            at += 1
        planes.append(rows[0])
        rows = carries[:at]
    return planes


def _reached(planes: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Bits (k, words) whose count is need (k) at least."""
    above, same = np.zeros_like(planes[0]), np.full_like(planes[0], ONES)
    for i in reversed(range(max(len(planes), int(need.max()).bit_length()))):
        digit = np.where(need >> i & 1 > 0, ONES, np.uint64(0))[:, None]
        plane = planes[i] if i < len(planes) else np.uint64(0)
        above |= same & plane & ~digit
        same &= ~(plane ^ digit)
    return above | same


class _Postings:
    """The sets of a tile by their grams, smaller sets first: a bit for each set, as whole rows of words for grams of many sets, as the words with a bit for the others."""

    def __init__(self, batches: list[pa.RecordBatch], schema: pa.Schema):
        rows = pa.Table.from_batches(batches, schema)
        rows = rows.take(pa.array(np.argsort(rows["n"].to_numpy(), kind="stable")))
        self.a, self.h, self.n = rows["a"].combine_chunks(), rows["h"].to_numpy(), rows["n"].to_numpy()
        self.words = -(-len(self.n) // 64)
        g = _hashes(rows["g"])
        order = np.argsort(g, kind="stable")
        g, at = g[order], np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[order]
        del order, rows
        new, word = np.append(True, g[1:] != g[:-1])[: len(g)], at >> 6  # a tile may have no sets
        first = np.flatnonzero(new | np.append(True, word[1:] != word[:-1])[: len(g)])
        self.mask, self.word = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first), word[first]
        new = np.flatnonzero(new)
        self.grams, self.starts = g[new], np.append(np.searchsorted(first, new), len(first))
        many = np.flatnonzero(np.diff(self.starts) > self.words // DENSE)
        self.row = np.zeros(len(self.grams) + 1, np.int32)  # 0: a row without bits, also that of the gram after the last, which no set has
        self.row[many] = np.arange(1, len(many) + 1)
        self.table = np.zeros((len(many) + 1, self.words), np.uint64)
        which, place = self._entries(many)
        self.table[which + 1, self.word[place]] = self.mask[place]

    def _entries(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of each of the grams, which gram's it is and where it lies."""
        n = self.starts[grams + 1] - self.starts[grams]
        return np.repeat(np.arange(len(grams)), n), np.repeat(self.starts[grams] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def matches(self, batch: pa.RecordBatch, threshold: float, names: list[str]):
        """Rows of sets x of the batch and larger ones y (of equal ones, of larger hash) that may hold enough of x; common is null where not all of x is here."""
        if not len(self.n) or not batch.num_rows:
            return
        batch = batch.take(pa.array(np.argsort(batch.column("n").to_numpy(), kind="stable")))
        nx, hx, ax, spelled = batch.column("n").to_numpy(), batch.column("h").to_numpy(), batch.column("a"), batch.column("g").to_pylist()
        p = np.array([len(x) // 8 for x in spelled])
        g = np.frombuffer(b"".join(spelled), np.uint64)
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        at = np.where(self.grams[at] == g, at, len(self.grams))
        starts = np.cumsum(p) - p
        need = np.maximum(1, p - _missing(nx, threshold))
        low = np.searchsorted(self.n, nx) >> 6  # words before hold smaller sets only
        i = 0
        while i < len(p) and low[i] < self.words:
            w = self.words - int(low[i])
            k = int(np.argmax(np.append(np.maximum.accumulate(p[i : i + CELLS]) * np.arange(1, len(p[i : i + CELLS]) + 1) * w > CELLS, True)))
            mine = slice(i, i + max(1, k))
            own = p[mine]
            which = np.repeat(np.arange(len(own)), own)
            turn = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            gram = at[np.repeat(starts[mine], own) + turn]
            row = np.zeros((own.max(), len(own)), np.int32)
            row[turn, which] = self.row[gram]
            bits = self.table[:, low[i] :][row]
            few = np.flatnonzero((self.row[gram] == 0) & (gram < len(self.grams)))
            entry, place = self._entries(gram[few])
            late = self.word[place] >= low[i]
            entry, place = few[entry[late]], place[late]
            bits[turn[entry], which[entry], self.word[place] - low[i]] = self.mask[place]
            planes = _bit_counts(bits)
            x, word = np.nonzero(reached := _reached(planes, need[mine]))
            hit, bit = np.nonzero(np.unpackbits(reached[x, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            x, word = x[hit], word[hit]
            y = (word + low[i]) * 64 + bit
            some = np.flatnonzero(y < len(self.n))
            x, y, word, bit = x[some], y[some], word[some], bit[some]
            some = np.flatnonzero((self.n[y] > nx[mine][x]) | ((self.n[y] == nx[mine][x]) & (self.h[y] > hx[mine][x])))
            x, y, word, bit = x[some], y[some], word[some], bit[some].astype(np.uint64)
            common = np.zeros(len(x), np.int32)
            for j, plane in enumerate(planes):
                common += (plane[x, word] >> bit & np.uint64(1)).astype(np.int32) << j
            x += i
            yield pa.RecordBatch.from_arrays(
                [ax.take(pa.array(x)), self.a.take(pa.array(y)), pa.array(hx[x]), pa.array(self.h[y]), pa.array(nx[x]), pa.array(self.n[y]), pa.array(common, mask=p[x] < nx[x])], names=names
            )
            i += len(own)


def _tiles(threshold: float, names: list[str]):
    def run(batches):
        tile, held, index = None, [], None
        for batch in batches:
            t, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((np.diff(t) != 0) | (np.diff(side) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(t)]):
                if hi == lo:
                    continue
                if t[lo] != tile:
                    tile, held, index = t[lo], [], None
                if side[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                else:
                    index = index or _Postings(held, batch.schema)
                    held = []
                    yield from index.matches(batch.slice(lo, hi - lo), threshold, names)

    return run


def _common(batches):
    """Rows as those of found, with common, of such rows with gx and gy for common."""
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), True)) for a, b in zip(batch.column("gx").to_pylist(), batch.column("gy").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(both, pa.int32())], names=["x", "y", "nx", "common"])


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows whose character 4-grams overlap by more than threshold of the smaller set, a < b.

    Equal sets are compared once, through the member with the least key, which is paired with each of the others; so every row is in the result
    if another is like it, and copies are not expanded into all pairs. Grams of prose are common, so postings are not joined: each set goes to tiles of posting
    lists, where the shared ones of its rarest grams are counted for 64 sets at once, by adding bits. A set that holds more than threshold of n grams lacks at most m of them, so of the p
    rarest it holds p - m; sets for which all grams are there are settled so, the few others on whole sets. Only p grams of a set go to every tile.
    """
    kind = df.schema[key].dataType.simpleString()
    grams = df.select(F.col(key).alias("id"), normalized(F.col(text)).alias("t")).mapInArrow(_sets, f"id {kind}, n int, g binary")
    grams = staged(grams.withColumn("h", F.xxhash64("g")))
    sets = staged(grams.groupBy("h", "n").agg(F.min("id").alias("a"), F.first("g").alias("g")).select("a", "h", "n", "g"))
    copies = grams.select("id", "h", "n").join(sets.select("h", "n", "a"), ["h", "n"]).filter("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    some = sets.filter("n > 0")
    f = np.zeros(BUCKETS, np.int64)
    counts = some.select("g").mapInArrow(_bucket_counts, "bucket long, f long").groupBy("bucket").agg(F.sum("f").alias("f")).toArrow()  # a row for each bucket
    f[counts["bucket"].to_numpy()] = counts["f"].to_numpy()
    size = some.agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).first()
    down = max(16, -(-size["sets"] // BLOCK), -(-(size["grams"] or 0) // GRAMS))
    across = max(1, -(-TILES // down))
    schema = f"a {kind}, h long, n int, g binary"
    first = some.mapInArrow(_rarest(df.sparkSession.sparkContext.broadcast(f), threshold), schema)
    tile = lambda x, y: (x * down + y).cast("int").alias("tile")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ys = some.withColumn("x", number(across)).select(tile(F.col("x"), F.pmod("h", F.lit(down))), F.lit(0).alias("side"), "a", "h", "n", "g")
    xs = first.withColumn("y", number(down)).select(tile(F.pmod(F.shiftright("h", 32), F.lit(across)), F.col("y")), F.lit(1).alias("side"), "a", "h", "n", "g")
    dealt = ys.unionByName(xs).repartition(across * down, "tile").sortWithinPartitions("tile", "side")
    pair = ["x", "y", "hx", "hy", "nx", "ny", "common"]
    found = staged(dealt.mapInArrow(_tiles(threshold, pair), f"x {kind}, y {kind}, hx long, hy long, nx int, ny int, common int"))
    of = lambda z: sets.select(F.col("h").alias("h" + z), F.col("n").alias("n" + z), F.col("g").alias("g" + z))
    rest = found.filter("common IS NULL").join(of("x"), ["hx", "nx"]).join(of("y"), ["hy", "ny"])
    rest = rest.select("x", "y", "nx", "gx", "gy").mapInArrow(_common, f"x {kind}, y {kind}, nx int, common int")
    near = found.filter("common IS NOT NULL").select("x", "y", "nx", "common").unionByName(rest).withColumn("similarity", F.col("common") / F.col("nx")).filter(F.col("similarity") > threshold).filter("x <> y")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("similarity", 6).alias("similarity")).unionByName(copies)
