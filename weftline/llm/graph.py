"""Connected components of an edge table: parts of it are joined in tasks, then by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from .common import drop_staged, stage

#: Edges of a part that one task joins.
PART_EDGES = 250_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node of each one's component."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def _joined(edges: DataFrame, parts: int) -> DataFrame:
    """As many edges as join what the edges of each of ``parts`` parts join, all to the least node."""

    def joined(batches):
        got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if got:
            nodes, roots = roots_of(*(np.concatenate(c) for c in zip(*got, strict=True)))
            apart = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart], pa.int64()), pa.array(roots[apart], pa.int64())], names=["a", "b"])

    ship_package(edges.sparkSession)
    return edges.repartition(parts).mapInArrow(joined, "a long, b long")


def _print(edges: DataFrame) -> tuple:
    """Size and order-free fingerprint of an edge table."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (``a, b``); the root is the component's least node.

    Parts of ``PART_EDGES`` edges are joined in tasks first; one part is all there is
    to do for a small table. Each round turns the edges towards the least neighbour on both sides; rounds
    grow with the logarithm of the longest path. Edges are staged in the shared
    folder each round. Loops and repeated edges do no harm; nodes without an edge to
    another node are not listed. No edges give no rows.
    """
    given = stage(edges.select("a", "b").filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parts = max(1, -(-given.count() // PART_EDGES))
    now = stage(_joined(given, parts), "edges")
    drop_staged(given)
    seen = _print(now) if parts > 1 else (0,)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        large = stage(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        after = stage(small, "edges")
        drop_staged(now)
        drop_staged(large)
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
