"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, ship, shuffle_partitions

#: Edges of a task that are tied into stars at a time.
CHUNK = 500_000


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Edges (u, v) of longs to (node, root): root is the least node of its component.

    Every node that stands on an edge gets one row. Loops and repeated edges are
    harmless, edges with a null end are ignored, no edges give no rows. Edges of a task are tied into stars first; each
    round is written to the shared folder. Raises if max_rounds don't suffice
    (a round about halves the distance to the root, so 40 is out of reach).
    """
    ship(edges.sparkSession)
    parts = shuffle_partitions(edges.sparkSession)
    tied = edges.where("u is not null and v is not null and u <> v").select("u", "v").mapInArrow(_stars, "u long, v long")
    now = settle(_by_node(tied, parts))
    for _ in range(max_rounds):
        # done when no root hangs from another node
        if not now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi").limit(1).count():
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
        done, now = now, settle(_small(_large(now, parts), parts))
        discard(done)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _by_node(edges: DataFrame, parts: int) -> DataFrame:
    """Distinct edges (u, v), u > v, those of one u together."""
    return edges.repartition(parts, "u").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in chunks, each to edges (node, least node of its component in the chunk)."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("u", "v")]))
        if sum(x.shape[1] for x in held) >= CHUNK:
            yield _star(np.concatenate(held, axis=1))
            held = []
    if held:
        yield _star(np.concatenate(held, axis=1))


def _star(edges: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(edges.shape)
    low = np.arange(len(nodes))
    while True:  # the least label of each edge's ends, then of the labels' labels
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, low[u], least)
        np.minimum.at(new, low[v], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    while (low[low] != low).any():
        low = low[low]
    apart = low != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[low[apart]])], names=["u", "v"])


def _large(edges: DataFrame, parts: int) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return _by_node(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")), parts)


def _small(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _by_node(rest.unionByName(least.select("u", F.col("m").alias("v"))), parts)
