"""Source divergence: how far the word use of each source of a language lies from that of its other sources, and which terms set it apart.

A tokenizer of one translate table lowers A to Z and turns separators into blanks in one pass over the bytes of a text; split and a Counter for each text
give its counts, which are summed by source and term within a task while they are few, then by Spark.

All arithmetic is on whole numbers. A source without a term still has a share of it, so that distances run over all terms of the language. Sources of a
language stand in tiles of TILE; each term goes once to each pair of tiles, as a sparse row, where a task adds the distances of all pairs of sources of these
tiles, terms by blocks. Terms that neither tile has add the same each and are added by their number.

Cases: null text, lang or source counts as ''; a group without a kept term takes part with counts of 0; rows that repeat count as documents of their own;
ties go by the bytes of the item; an empty table gives no rows; texts are taken whole; other columns are ignored.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, looked_up, materialize, table

#: Documents of a language that a term must be in, distinguishing terms of a group that are told, what shares are multiples of.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Entries that a task sums before it gives them away; sources of a tile; distances that a task computes at once.
HELD, TILE, AT_ONCE = 1 << 18, 256, 1 << 22

#: Bytes that are part of terms stay (upper case lowered), all others become blanks.
TRANSLATE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def text_counts(text: str) -> Counter:
    return Counter(text.encode().translate(TRANSLATE).split())


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = [*n]
            for i in range(0, len(terms), 1 << 16):
                part = terms[i : i + (1 << 16)]
                columns = [[lang] * len(part), [source] * len(part), [t.decode() for t in part], [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
            counts = text_counts(text.as_py() or "")
            n, docs = held.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter({b"": 0}), Counter()))
            size -= len(n)
            n.update(counts)
            docs.update(counts.keys())
            size += len(n)
            if size > HELD:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row of the empty term with n = 0 for each group."""
    parts = docs.select("text", "lang", "source").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * n / total) of two SQL expressions, n <= total, by three steps of long division, which are exact for totals up to 9e15."""
    rest, digits = f"({n})", []
    for _ in range(3):
        digits.append(f"({rest} * 1000) div ({total})")
        rest = f"(({rest} * 1000) % ({total}))"
    return F.expr(f"1 + ({digits[0]}) * 1000000 + ({digits[1]}) * 1000 + ({digits[2]})")


#: Distance of two shares p and q.
DISTANCE = "((p - q) * (p - q)) div (p + q)"


def _tile_sums(batches):
    """Sums of distances between the sources of two tiles over the terms that come, and the number of these terms."""
    sums: dict[tuple[str, int, int], list] = {}

    def dense(rows, base):
        out = np.tile(np.array(base, np.int64), (len(rows), 1))
        for k, entries in enumerate(rows):
            for e in entries:
                out[k, e["i"]] = e["p"]
        return out

    def rows():
        for (lang, a, b), (total, n) in sums.items():
            i, j = (x.ravel() for x in np.indices(total.shape))
            tiles = {c: pa.array(np.full(len(i), x, np.int32)) for c, x in (("a", a), ("b", b))}
            places = {c: pa.array(x.astype(np.int32)) for c, x in (("i", i), ("j", j))}
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(i), pa.string()), **tiles, **places, "value": pa.array(total.ravel()), "terms": pa.array(np.full(len(i), n, np.int64))})

    for batch in batches:
        places: dict[tuple[str, int, int], list[int]] = {}
        for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            places.setdefault(key, []).append(k)
        for key, at in places.items():
            base = [batch.column(c)[at[0]].as_py() for c in (4, 6)]
            step = max(1, AT_ONCE // (len(base[0]) * len(base[1])))
            total = np.zeros((len(base[0]), len(base[1])), np.int64)
            for s in range(0, len(at), step):
                p, q = (dense(batch.column(c).take(pa.array(at[s : s + step])).to_pylist(), x) for c, x in zip((3, 5), base))
                p, q = p[:, :, None], q[:, None, :]
                total += ((p - q) ** 2 // (p + q)).sum(axis=0)
            old = sums.setdefault(key, [np.zeros_like(total), 0])
            old[0] += total
            old[1] += len(at)
        if sum(x[0].size for x in sums.values()) > AT_ONCE:
            yield from rows()
            sums = {}
    yield from rows()


def divergence(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): in part 'pair' every other source of the language by distance, in part 'term' the terms that a source uses
    more than its language does, the ``top`` first by distance."""
    counts = materialize(term_counts(docs))
    seen = counts.filter("term <> ''")
    kept = materialize(seen.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least).drop("docs"))
    langs = few(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")))
    own = materialize(seen.drop("docs").join(kept, ["lang", "term"]))
    total = own.count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.filter("term = ''").select("lang", "source").withColumn("place", place)
    groups = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("times")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["words", "times", "v", "lang_total"]).withColumn("base", F.when(F.col("v") > 0, share("2", "words + 2 * v")))
    groups = materialize(groups.withColumn("tile", F.floor(F.col("place") / TILE).cast("int")).withColumn("i", (F.col("place") % TILE).cast("int")))
    shares = looked_up(own, groups.filter("v > 0"), ["lang", "source"], total).withColumn("p", share("n + 2", "words + 2 * v")).withColumn("q", share("lang_n + 2", "lang_total + 2 * v"))
    return _pairs(shares, groups).unionByName(_terms(shares, top))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    apart = shares.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(DISTANCE).alias("value"))
    return _ranked(apart).filter(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    tiles = few(groups.filter("v > 0").groupBy("lang", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda x: x["base"]).alias("base")))
    tile = lambda x: tiles.select("lang", F.col("tile").alias(x), F.col("base").alias(f"base_{x}"))
    own = shares.groupBy("lang", "term", "tile").agg(F.collect_list(F.struct("i", "p")).alias("entries"))  # at most one entry for each source of a tile
    none = F.array().cast("array<struct<i:int,p:bigint>>")
    # a term goes to every pair of tiles of which one has it, once
    to = own.join(tiles.select("lang", F.col("tile").alias("other")), "lang").withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other"))
    both = to.groupBy("lang", "term", "a", "b").agg(
        F.max(F.when(F.col("tile") == F.col("a"), F.col("entries"))).alias("p"),
        F.max(F.when(F.col("tile") == F.col("b"), F.col("entries"))).alias("q"),
    )
    rows = both.join(tile("a"), ["lang", "a"]).join(tile("b"), ["lang", "b"])
    rows = rows.select("lang", "a", "b", F.coalesce("p", none).alias("p"), "base_a", F.coalesce("q", none).alias("q"), "base_b")
    sums = rows.mapInArrow(_tile_sums, "lang string, a int, b int, i int, j int, value long, terms long").groupBy("lang", "a", "b", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    sums = sums.select("lang", (F.col("a") * TILE + F.col("i")).alias("x"), (F.col("b") * TILE + F.col("j")).alias("y"), "value", "terms", (F.col("a") == F.col("b")).alias("same"))
    sums = sums.select("lang", F.explode(F.when(F.col("same"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).alias("o"), "value", "terms").select("lang", "o.*", "value", "terms")
    side = lambda x, name: groups.select("lang", F.col("source").alias(name), F.col("place").alias(x), F.col("base").alias(f"base_{x}"), *["v"] * (x == "x"))
    pairs = side("x", "source").join(few(side("y", "item")), "lang").filter("x <> y").join(sums, ["lang", "x", "y"], "left")
    apart = F.expr(DISTANCE.replace("p", "base_x").replace("q", "base_y"))
    value = F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + (F.col("v") - F.coalesce("terms", F.lit(0))) * apart).otherwise(0)
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
