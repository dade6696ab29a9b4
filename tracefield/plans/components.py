"""Connected components.

Up to ``LOCAL_EDGES`` edges are labelled in one task (their size is counted
first). Beyond that, by alternating large and small stars: every step is a pair
of aggregation and join over the edges, in which the edges of one vertex are
dealt over ``SHARES`` groups, so that a hub's don't meet in one task. The edges
are written to the shared folder after each step, so that lineage stays short
and lost executors cost at most one step. Labels are the least vertex of a
component. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, save

#: Edges that one task takes (16 bytes each).
LOCAL_EDGES = 1_000_000
#: Groups that a vertex's edges are dealt over.
SHARES = 64
_OUT = "vertex long, component long"


def label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b), and the least vertex of each one's component."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(vertices))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return vertices, vertices[parent]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            vertices, components = label(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(components)], names=["vertex", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, _OUT)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's greater (large) or lesser (small) neighbours to its least neighbour, itself included."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)))
    parts = both.groupBy("a", "share").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(parts.select("a", "share").join(least, "a"), ["a", "share"])
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, limit: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """``vertex`` and ``component`` (the least vertex reachable) of all vertices of ``edges`` (two columns of ids).

    Direction, repeated edges and self-loops don't matter; edges with a null
    are left out. A vertex that has self-loops only has no row. No edges, no rows.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    now = save(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= local and dict(now.dtypes)["a"] in ("int", "bigint"):
        return _in_one_task(now.select(F.col("a").cast("long"), F.col("b").cast("long")))
    mark = None
    for _ in range(limit):
        half = save(_star(now, True), "edges")
        after = save(_star(half, False), "edges")
        discard(now, half)
        now = after
        # The star edges are stable when neither their number nor their sum changes.
        seen = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
