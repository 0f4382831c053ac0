"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words: a share of all words by its weight, but at most CAP times its own; what is above is shared anew.
Document rates start at 1 and lie between 0 and CAP; of all rates that meet the targets, those of least divergence from the start have the
form CAP / (1 + (CAP - 1) exp(-lambda x)), x being the document's words over its source's mean. The multipliers lambda minimise a convex dual
and are found by Newton steps; each step is one aggregation over counts of (source, size), never over texts. Rates are then rounded: a
document takes the whole part, and one more where a hash of it lies below its fraction plus a shift that its source chooses so that the
words taken meet the target; last, single copies of the documents whose sizes come nearest to what is missing or too much are added or taken away,
up to PASSES in each source. Which these are is told from candidates, PASSES at most of each source, size and number of copies. Tables with a row for each
source go to every task while they have no more than SENT_ROWS rows; beyond, the rows of the largest sources are dealt out (see common.joined()).

Cases: null text has size 0; a null source is a source of its own, the last in order; documents of size 0 take one copy and no words; rows that
repeat doc_id, source and size get equal copies (ties, which one correction changes together); an empty table gives no rows; other columns are ignored by mix() and kept by mixed().
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, looked_up, materialize, table, word_count

CAP = 3
WEIGHTS = (1, 2, 3)
#: Newton steps at most, and the relative error of a source's words at which they end.
STEPS, TOLERANCE = 40, 1e-4
#: Slots of the rounding key in which a source's words are summed, and passes that add or take away single copies.
SLOTS, PASSES = 4096, 6


def source_targets(sizes: DataFrame) -> DataFrame:
    """(s, source_size, target) from sizes(s, size, n). One row per source goes through the window that orders them, no documents."""
    sources = sizes.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("s").startswith("0"), "s")
    all_ = Window.partitionBy()
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    # sources fill up in the order of cap / weight; the level is the first at which all that follow stay below their caps
    out = out.withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0))
    weight = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / weight).withColumn("fits", F.col("level") <= F.col("ratio"))
    out = out.withColumn("level", F.max(F.when(F.col("fits"), F.struct((-F.col("ratio")).alias("k"), F.col("level").alias("v")))).over(all_)["v"])
    target = F.least(CAP * F.col("source_size").cast("double"), F.col("level") * F.col("weight"))
    return out.select("s", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), (F.col("source_size") / F.col("docs")).alias("mean"), F.col("docs").alias("times"))


def rate(multiplier: Column, x: Column) -> Column:
    return F.lit(float(CAP)) / (F.lit(1.0) + F.lit(CAP - 1.0) * F.exp(-multiplier * x))


def solve(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with the column multiplier: null where the target is all or nothing (0 or CAP times the source)."""
    inner = (F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size") * (1 - 1e-9))
    lam, nothing = F.col("multiplier"), F.lit(None).cast("double")
    state = materialize(targets.withColumns({"multiplier": F.when(inner, 0.0), "low": nothing, "high": nothing}))
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size")
        r = rate(lam, x)
        sums = sizes.join(state.filter(lam.isNotNull()).select("s", "multiplier", "mean"), "s").groupBy("s").agg(F.sum(words * r).alias("got"), F.sum(words * x * r * (1 - r / CAP)).alias("slope"))
        off = F.col("got") - F.col("target")
        state = state.join(sums, "s", "left").withColumn("error", off / F.col("target"))
        state = state.withColumns({"low": F.when(off < 0, F.greatest("low", "multiplier")).otherwise(F.col("low")), "high": F.when(off >= 0, F.least("high", "multiplier")).otherwise(F.col("high"))})
        most = 2 * F.greatest(F.lit(1.0), F.abs(lam))
        step = lam - F.greatest(-most, F.least(most, F.coalesce(off / F.nullif(F.col("slope"), F.lit(0.0)), F.signum(off) * most)))
        step = F.when((step <= F.col("low")) | (step >= F.col("high")), F.coalesce((F.col("low") + F.col("high")) / 2, step)).otherwise(step)
        state = materialize(state.withColumn("multiplier", F.when(F.abs("error") > TOLERANCE / 10, step).otherwise(lam)).select("s", "source_size", "target", "mean", "times", "multiplier", "low", "high", "error"))
        if (state.agg(F.max(F.abs("error"))).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("s", "source_size", "target", "mean", "times", "multiplier")


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("s", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))).withColumn("size", word_count(F.col("text")))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, s, size, source_size, target, taken, copies, rate) of every document; taken = copies * size."""
    light = materialize(_key(docs.select("doc_id", "source", "text")).select("doc_id", "s", "size"))
    sizes = materialize(light.groupBy("s", "size").agg(F.count("*").alias("n")))
    state = solve(sizes, materialize(source_targets(sizes)))
    lam = F.col("multiplier")
    edge = F.when(F.col("target") > 0, float(CAP)).otherwise(F.when(F.col("size") > 0, 0.0).otherwise(1.0))
    total = light.count()
    rows = looked_up(light, state, ["s"], total).withColumn("rate", F.when(lam.isNull(), edge).otherwise(rate(lam, F.col("size") / F.col("mean"))))
    rows = rows.withColumn("whole", F.floor("rate").cast("int")).withColumn("u", F.xxhash64("doc_id", "s", "size") / F.lit(2.0**64) + 0.5)
    rows = rows.withColumn("key", F.col("u") - (F.col("rate") - F.col("whole"))).withColumn("slot", F.floor((F.col("key") + 1) * (SLOTS // 2)).cast("int"))
    more = (F.col("whole") < CAP) & (F.col("size") > 0)
    # the slot of each source in which the words still needed are reached
    slots = rows.groupBy("s", "slot").agg(F.sum(F.when(more, F.col("size")).otherwise(0)).alias("in_slot"), F.sum(F.col("whole") * F.col("size")).alias("base"), F.max("target").alias("target"))
    by_slot = Window.partitionBy("s").orderBy("slot")
    slots = slots.withColumn("need", F.col("target") - F.sum("base").over(Window.partitionBy("s"))).withColumn("upto", F.sum("in_slot").over(by_slot))
    edge_slot = slots.groupBy("s").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("slot", (F.col("need") - F.col("upto") + F.col("in_slot")).alias("rest")))).alias("e")).select("s", F.coalesce("e.slot", F.lit(SLOTS)).alias("edge"), F.coalesce("e.rest", F.lit(0.0)).alias("rest"))
    edge_slot = edge_slot.join(state.select("s", "times"), "s")
    rows = materialize(looked_up(rows, edge_slot, ["s"], total))
    by_key = Window.partitionBy("s").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = rows.filter(more & (F.col("slot") == F.col("edge"))).withColumn("upto", F.sum("size").over(by_key)).filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    chosen = few(at_edge.select("s", "u").distinct().withColumn("extra", F.lit(1)))
    rows = rows.join(chosen, ["s", "u"], "left")
    extra = F.when(more & (F.col("slot") < F.col("edge")), 1).otherwise(F.coalesce("extra", F.lit(0)))
    rows = materialize(rows.withColumn("copies", F.col("whole") + extra).select("doc_id", "s", "size", "source_size", "target", "rate", "u", "copies"))
    rows = rows.join(few(_corrections(rows)), ["s", "size", "u"], "left").withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int"))
    return rows.select("doc_id", "s", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def _corrections(rows: DataFrame) -> DataFrame:
    """(s, size, u, change) of single copies that are added or taken away in a source: each time that of the document whose size comes nearest to what
    is missing or too much, if that is less then."""
    missing = materialize(rows.groupBy("s").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing")))
    first = Window.partitionBy("s", "size", "copies").orderBy("u")
    some = rows.filter("size > 0").select("s", "size", "copies", "u").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= PASSES).drop("k")
    some = materialize(some.withColumn("change", F.lit(0)))
    lack = F.col("missing")
    for _ in range(PASSES):
        open_ = (F.col("change") == 0) & (F.col("size") < 2 * F.abs(lack)) & (((lack > 0) & (F.col("copies") < CAP)) | ((lack < 0) & (F.col("copies") > 0)))
        best = F.min(F.struct(F.abs(F.abs(lack) - F.col("size")).alias("rest"), "u", "size", F.signum(lack).cast("int").alias("sign"))).alias("p")
        picked = materialize(some.join(missing, "s").filter(open_).groupBy("s").agg(best).select("s", F.col("p.size").alias("p_size"), F.col("p.u").alias("p_u"), F.col("p.sign").alias("sign")))
        if not picked.head(1):
            break
        own = (F.col("size") == F.col("p_size")) & (F.col("u") == F.col("p_u"))
        some = materialize(some.join(picked, "s", "left").withColumn("change", F.when(own, F.col("sign")).otherwise(F.col("change"))).select("s", "size", "copies", "u", "change"))
        missing = materialize(missing.join(picked, "s", "left").select("s", (lack - F.coalesce(F.col("sign") * F.col("p_size"), F.lit(0))).alias("missing")))
    return some.filter("change <> 0").select("s", "size", "u", "change").distinct()


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as mix() takes it; all columns are kept."""
    copies = mix(docs).select(F.col("doc_id").alias("id"), "s", "size", "copies").distinct().alias("c")
    own = _key(docs.select("doc_id", "source", "text", F.struct("*").alias("whole"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.id")) & (F.col("d.s") == F.col("c.s")) & (F.col("d.size") == F.col("c.size"))
    return own.join(copies, same).filter("copies > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("s", "copies", "rate")
