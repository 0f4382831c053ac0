"""Connected components of an edge table by contraction: each task ties what it sees together, then edges are dealt anew by both their ends."""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, lean, materialize

ROUNDS = 60
#: Edges to one node from which it is sent to all tasks, if these are also more than one HOT_KEYS-th of all edges, rather than its edges to one task.
HOT_EDGES = 10_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that it reaches, but for the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[u], top[v]
        if (x == y).all():
            break
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(top, up := top[top]):
            top = up
    low = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[low], nodes[top[low]]


def _contract(batches):
    held = [np.zeros(0, np.int64)] * 2
    rows: list[list[np.ndarray]] = []
    size = 0

    def all_rows() -> list[np.ndarray]:
        return list(stars(*(np.concatenate([held[i], *(r[i] for r in rows)]) for i in (0, 1))))

    for batch in batches:
        rows.append([batch.column(i).to_numpy() for i in (0, 1)])
        size += batch.num_rows
        if size > max(1 << 18, len(held[0])):
            held, rows, size = all_rows(), [], 0
    held = all_rows()
    for i in range(0, len(held[0]), 1 << 16):
        yield pa.RecordBatch.from_pydict({"a": held[0][i : i + (1 << 16)], "b": held[1][i : i + (1 << 16)]})


def tied(run):
    """A function over Arrow batches that contracts the edges of run() in the same worker; two Python steps in a stage take two workers for each task."""

    @functools.wraps(run)
    def out(batches):
        return _contract(run(batches))

    return out


def connected_components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, component) of every node of edges(a, b), both longs; component is the smallest node that it reaches. ``contracted`` says that a Python step
    has tied what it saw just before, so that the first round only drops what repeats.

    Each round sends an edge to the tasks of both its ends, which tie all that they see to the smallest node; the number of rounds is logarithmic in the
    longest path. A node of very many edges is the smallest end of most of them: its own smaller neighbour goes to these edges instead. Every
    round is written to the shared folder.
    """
    contract = lambda e: e.mapInArrow(lean(_contract), "a long, b long").distinct()
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(e.distinct() if contracted else contract(e))
    for _ in range(ROUNDS):
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        total, open_, most = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0))), F.coalesce(F.max("down"), F.lit(0))).first()
        if not open_:
            break
        least = max(HOT_EDGES, total // HOT_KEYS)
        if most > least:
            hot = F.broadcast(ends.filter(F.col("down") > least).select(F.col("node").alias("b")))  # fewer than HOT_KEYS
            above = e.join(hot.select(F.col("b").alias("a")), "a").groupBy("a").agg(F.min("b").alias("top")).select(F.col("a").alias("b"), "top")
            moved = e.join(hot.withColumn("hot", F.lit(True)), "b", "left").join(F.broadcast(above), "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.col("hot").isNotNull().alias("hot"))
        else:
            moved = e.withColumn("hot", F.lit(False))
        by_end = moved.withColumn("end", F.explode(F.when(F.col("hot"), F.array("a")).otherwise(F.array("a", "b"))))
        e = materialize(contract(by_end.repartition("end").select("a", "b")))
    else:
        raise RuntimeError("components did not settle")
    both = e.unionByName(e.select(F.col("b").alias("a"), "b").distinct())
    return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
