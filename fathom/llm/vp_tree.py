"""Approximate nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to shards by a hash of their id; a shard's tree splits its vectors at the median distance
from a vantage point, down to leaves that are scanned. With the k-th nearest distance tau found so far, a half
is skipped when it cannot hold anything nearer: |d(query, vantage) - radius| * relax > tau. relax = 1 is the triangle
inequality and exact; a larger factor skips more. Every vector is indexed.

Each tree is built once and written to the shared folder. A tree then meets all queries as a stream, a block at a
time: a block goes down the tree together, each query by its own order and bounds. Shards and blocks are of bounded size, so neither
queries nor vectors are ever all in one task. The k best of each shard are merged per query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship, shuffle_partitions

#: Numbers (components of vectors) in a shard, queries in a block, vectors in a leaf, numbers compared at a time.
SHARD, BLOCK, LEAF, CELLS = 1 << 20, 2048, 256, 1 << 21
_NO_ID = np.iinfo(np.int64).max


class VpTree:
    """ids: int64, vectors: rows. Vantage points are those farthest from the mean of their part, by a fixed rule.

    nodes: (first row, end of rows) of a leaf, or (vantage row, radius, near node, far node); the last is the root.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf, self.nodes, self._order = leaf, [], []
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        self._build(np.arange(len(ids)), vectors.astype(np.float64), 0)
        order = np.array(self._order, np.int64)
        del self._order
        self.ids, self.vectors = ids[order], vectors[order]

    def _build(self, rows: np.ndarray, vectors: np.ndarray, depth: int) -> int:
        split = None
        if len(rows) > self.leaf and depth < 64:
            part = vectors[rows]
            top = int(np.argmax(distances(part.mean(0), part)))
            rest = np.delete(rows, top)
            d = distances(vectors[rows[top]], vectors[rest])
            radius = float(np.median(d))
            near = d <= radius
            split = None if near.all() else (rows[top], radius, rest[near], rest[~near])  # all tied: nothing to split
        at = len(self._order)
        if split is None:
            self._order += rows.tolist()
            self.nodes.append((at, len(self._order)))
        else:
            self._order.append(int(split[0]))
            self.nodes.append((at, split[1], self._build(split[2], vectors, depth + 1), self._build(split[3], vectors, depth + 1)))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """For each query its k nearest: distances (infinite where there are fewer) and ids; ties to the smaller id, the id in `own` left out."""
        return _Walk(self, queries, own, k, relax).found()


class _Walk:
    """A block of queries on its way through a tree."""

    def __init__(self, tree: VpTree, queries: np.ndarray, own: np.ndarray, k: int, relax: float):
        self.tree, self.queries, self.own, self.k, self.relax = tree, queries.astype(np.float64), own, k, relax
        self.vectors = tree.vectors.astype(np.float64)
        self.squares = (self.vectors**2).sum(1)
        self.best = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), _NO_ID)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.vectors) and len(self.queries):
            self._visit(len(self.tree.nodes) - 1, np.arange(len(self.queries)), np.zeros(len(self.queries)))
        return self.best, self.ids

    def _visit(self, node: int, which: np.ndarray, bound: np.ndarray) -> None:
        """bound: a least distance of each query to all that lies below the node."""
        hopeful = ~(bound * self.relax > self.best[which, -1])
        which, bound = which[hopeful], bound[hopeful]
        if not len(which):
            return
        if len(self.tree.nodes[node]) == 2:
            self._scan(*self.tree.nodes[node], which)
            return
        at, radius, near, far = self.tree.nodes[node]
        d = distances(self.vectors[at], self.queries[which])
        self._offer(which, np.full(len(which), at), d)
        slack = 1e-12 * (d + radius)  # of rounding
        to_near, to_far = np.maximum(bound, d - radius - slack), np.maximum(bound, radius - d - slack)
        inside = d <= radius
        for part, first, then, a, b in ((inside, near, far, to_near, to_far), (~inside, far, near, to_far, to_near)):
            self._visit(first, which[part], a[part])  # the half that holds the query comes first
            self._visit(then, which[part], b[part])

    def _scan(self, lo: int, hi: int, which: np.ndarray) -> None:
        """Rows lo to hi: an estimate by products finds the few whose distance is then taken exactly."""
        step = max(1, CELLS // (hi - lo))
        for part in (which[i : i + step] for i in range(0, len(which), step)):
            q = self.queries[part]
            square = (q**2).sum(1)
            estimate = square[:, None] + self.squares[lo:hi] - 2 * (q @ self.vectors[lo:hi].T)
            limit = self.best[part, -1] ** 2
            if hi - lo > self.k + 1:
                limit = np.minimum(limit, np.partition(estimate, self.k, axis=1)[:, self.k])  # one more, for the query itself
            limit = limit + 1e-9 * (square + self.squares[lo:hi].max())
            r, c = np.nonzero(~(estimate > limit[:, None]))
            for i in range(0, len(r), CELLS // 64):
                one, row = part[r[i : i + CELLS // 64]], c[i : i + CELLS // 64] + lo
                self._offer(one, row, np.sqrt(((self.vectors[row] - self.queries[one]) ** 2).sum(1)))

    def _offer(self, which: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Put candidates among the best of their queries."""
        ids = self.tree.ids[rows]
        fits = ((ids != self.own[which]) | (d > 0)) & (d <= self.best[which, -1])  # a query is the row of its id at no distance
        if not fits.any():
            return
        which, ids, d = which[fits], ids[fits], d[fits]
        asked = np.unique(which)
        every = np.concatenate([np.repeat(asked, self.k), which])
        far, names = np.concatenate([self.best[asked].ravel(), d]), np.concatenate([self.ids[asked].ravel(), ids])
        order = np.lexsort((names, far, every))
        every, far, names = every[order], far[order], names[order]
        start = np.searchsorted(every, every)
        rank = np.arange(len(every)) - start
        kept = rank < self.k
        self.best[every[kept], rank[kept]], self.ids[every[kept], rank[kept]] = far[kept], names[kept]


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.sqrt(((many - one) ** 2).sum(1))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def trees(rows: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """rows(vec_id, v) to (dims, shard, tree), one tree a shard and length of vectors, written to the shared folder; and the number of shards."""
    ship(rows.sparkSession)
    shards = max(1, -(-(rows.agg(F.sum(F.size("v"))).first()[0] or 0) // shard))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = VpTree(group.vec_id.to_numpy(), np.stack(group.v.to_list()))
        return pd.DataFrame({"dims": group.dims.iloc[:1], "shard": group.shard.iloc[:1], "tree": [pickle.dumps(tree)]})

    dealt = rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    return settle(dealt.groupBy("dims", "shard").applyInPandas(build, "dims int, shard int, tree binary")), shards


def _searched(k: int, relax: float):
    def answers(tree: VpTree | None, asked: list[tuple[int, int]], held: list) -> Iterator[pa.RecordBatch]:
        if tree is not None and asked:
            own, mark = np.array(asked, np.int64).T
            d, found = tree.search(np.stack(held), own, k, relax)
            q, at = np.nonzero(found != _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(mark[q]), pa.array(found[q, at]), pa.array(d[q, at])], names=["query_id", "mark", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, ids, held = None, None, [], []
        for batch in batches:
            for dims, shard, packed, vec_id, mark, v in zip(*(batch.column(c).to_pylist() for c in ("dims", "shard", "tree", "vec_id", "mark")), batch.column("v")):
                if (dims, shard) != at or len(ids) >= BLOCK:
                    yield from answers(tree, ids, held)
                    ids, held = [], []
                    if (dims, shard) != at:
                        at, tree = (dims, shard), None
                if packed is not None:
                    tree = pickle.loads(packed)
                else:
                    ids.append((vec_id, mark))
                    held.append(v.values.to_numpy())
        yield from answers(tree, ids, held)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, relax: float = 1.0, shard: int = SHARD) -> DataFrame:
    """vectors(vec_id, embedding), `queries` a condition on its rows: query_id, rank, vec_id, score.

    Each query's k nearest rows by Euclidean distance in double precision, itself not counted (all candidates if fewer than k);
    nearest first, ties to the smaller vec_id. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows with a null vec_id, take no part; vectors of
    different lengths never meet. Rows that share a vec_id with other vectors are rows like any
    other, as candidates and as queries, each with a list of its own; equal rows count once. Other columns are ignored.
    shard: numbers in a shard.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id", "v").agg(F.max("asks").alias("asks"))
    built, shards = trees(rows.select("vec_id", "v"), shard)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = rows.where("asks").select(F.size("v").alias("dims"), every, F.lit(None).cast("binary").alias("tree"), "vec_id", F.xxhash64("v").alias("mark"), "v")
    held = built.select("dims", "shard", "tree", *[F.lit(None).cast("long").alias(c) for c in ("vec_id", "mark")], F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
    met = held.unionByName(asking).repartition(max(shards, shuffle_partitions(vectors.sparkSession)), "dims", "shard").sortWithinPartitions("dims", "shard", F.col("tree").isNull())
    found = met.mapInArrow(_searched(k, relax), "query_id long, mark long, vec_id long, score double")
    top = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
