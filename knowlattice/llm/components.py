"""Connected components of an edge table: in one task while its edges are few, else by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, written

#: So many edges between whole numbers, at most, meet in one task (some 100 MB there).
TASK_EDGES = 1 << 20


def labels(n: int, near: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` places the smallest one reachable over the pairs of ``near``."""
    label = np.arange(n)
    for a, b in near:
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads all edges (a, b): each node with its root."""
    held = [(column(e, "a").to_numpy(), column(e, "b").to_numpy()) for e in batches if e.num_rows]
    if not held:
        return
    a, b = (np.concatenate(side) for side in zip(*held))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[labels(len(nodes), [(place[: len(a)], place[len(a) :])])]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node reachable over ``edges`` (a, b: two comparable columns), for each node in an edge.

    Up to ``TASK_EDGES`` edges of longs meet in one task, since each step over all tasks takes the driver's memory for its
    plans, however few the edges are. Of more edges, or other types, no neighbour list is ever gathered: each step takes the minimum of a node's neighbours by ``groupBy`` and joins
    it back to the edges; a node of so many edges that their partition is large is split by Spark's adaptive execution. Self loops and nulls carry no link; repeated and reversed edges are one. An empty edge
    table has no rows. Rounds grow with the logarithm of a component's size.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = edges.where(F.col("a") != F.col("b")).select(pair("a", "b").alias("e")).select("e.*")
    if all(f.dataType == T.LongType() for f in edges.schema):
        edges = written(edges, "edges")
        if edges.count() <= TASK_EDGES:
            return written(edges.coalesce(1).mapInArrow(_rooted, "node long, root long"), "components")
    edges, seen = written(edges.distinct(), "edges"), None
    while True:
        # Large star: each larger neighbour of a node goes to the node's smallest neighbour (or the node).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
