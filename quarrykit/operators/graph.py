"""Node and edge tables: neighbourhoods, induced edges, timelines."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of what start(node) reaches within depth undirected steps of edges(src, dst).

    Edges and each level are written once, so that a level reads the edges and the levels before it, and the plan of one level does not hold those before.
    """
    both = staged(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    seen = frontier = staged(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = staged(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are in nodes(node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node) that no edge touches."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_anti")


def typed_edges(parts: list[tuple[str, DataFrame]], nodes: DataFrame) -> DataFrame:
    """(src, dst, kind) of all parts, each once, with both ends among nodes(node)."""
    out = None
    for kind, e in parts:
        one = e.select("src", "dst").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return induced_edges(out.distinct(), nodes).select("src", "dst", "kind")


def timeline(parts: list[tuple[str, DataFrame]], limit: int) -> DataFrame:
    """The last limit rows of parts(at, label) in order of time, then of the parts."""
    out = None
    for i, (kind, p) in enumerate(parts):
        one = p.select("at", "label").withColumns({"kind": F.lit(kind), "kind_order": F.lit(i)})
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("at"), F.desc("kind_order"), F.desc("label")).limit(limit).drop("kind_order")


def replay(births: DataFrame, step_ms: int) -> DataFrame:
    """(topic, step, born, mean_confidence) of births(topic, at, confidence): what had been born by the end of each step, running over steps that had a birth."""
    by_step = births.withColumn("step", F.floor(F.col("at") / step_ms)).groupBy("topic", "step").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    w = Window.partitionBy("topic").orderBy("step")
    out = by_step.withColumns({"born": F.sum("n").over(w), "total": F.sum("s").over(w)})
    return out.select("topic", "step", "born", F.round(F.col("total") / F.col("born"), 6).alias("mean_confidence"))


#: Characters of the names that one automaton holds at most; more names take more passes over the texts.
NAME_CHARS = 4_000_000


def _automaton(names: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for n in names:
        out.add_word(n, n)
    out.make_automaton()
    return out


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(key, entity, place) of names(name) that a text holds literally, longest first, ``most`` at most; empty and null names are in no text.

    An automaton of all names reads each text once, in time that grows with the text and its finds alone. Names go to the tasks in parts of some NAME_CHARS
    characters, so that what is sent has a bound; only with more than one part are finds of a text brought together by a shuffle.
    """
    names = staged(names.select("name").filter("name <> ''").distinct())
    chars = names.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    parts = -(-chars // NAME_CHARS)
    kind = texts.schema[key].dataType.simpleString()
    context = texts.sparkSession.sparkContext

    def search(sent):
        def run(batches):
            found = _automaton(sent.value)
            for batch in batches:
                keys, entities, places = [], [], []
                for k, t in zip(batch.column(0), batch.column(1), strict=True):
                    own = sorted({n for _, n in found.iter(t.as_py() or "")}, key=lambda n: (-len(n), n))[:most]
                    keys += [k] * len(own)
                    entities += own
                    places += range(1, len(own) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.schema.field(0).type), pa.array(entities, pa.string()), pa.array(places, pa.int32())], names=[key, "entity", "place"])

        return texts.select(key, text).mapInArrow(run, f"{key} {kind}, entity string, place int")

    part = F.pmod(F.xxhash64("name"), F.lit(max(parts, 1)))
    out = None
    for i in range(parts):
        one = search(context.broadcast([r["name"] for r in names.filter(part == i).select("name").collect()]))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return texts.limit(0).select(key, F.lit("").alias("entity"), F.lit(0).alias("place"))
    if parts > 1:
        out = out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("entity")), "entity")))
    return out if most is None else out.filter(F.col("place") <= most)


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations with src and dst, names, as ids of entities(id, name); names match without regard to case and outer space, self loops and unknown names go."""
    key = lambda c: F.lower(F.trim(c))
    ids = entities.groupBy(key("name").alias("__k")).agg(F.min("id").alias("__id"))
    out = relations
    for end in ("src", "dst"):
        out = out.withColumn("__k", key(end)).join(ids, "__k").withColumn(end, F.col("__id")).drop("__k", "__id")
    return out.filter("src <> dst")
