"""A stored vector index: an inverted file of cells around centroids, one for each length of vectors.

Centroids come from a bounded sample, by k-means on the unit sphere; every row is then put into the cell of its nearest centroid. A cell is a folder, and
the largest angle of its rows to the centroid is kept. A search reads cells in turn and scores their rows exactly: either `probes` of them, more only while too
few rows pass the filter, or as many as it takes until no cell that is left can hold a better row (its centroid's angle to the query, less its
own, tells how near a row of it could be). Only the k best rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import vectors
from fathom.operators import retrieval
from fathom.session import ship
from fathom.sources.commits import CommitLog

#: Rows of the sample for each cell, rounds of k-means, cells read first.
SAMPLED, ROUNDS, FIRST = 40, 8, 4
#: Scores are compared at six digits; a cell is left out only if it can't reach the last of them.
ROUNDING = 2e-6


def centroids_of(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors: k-means by cosine. Fewer than `cells` if there are fewer different vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centers = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


def _placed(centers: np.ndarray, at: int):
    """Batches with two columns more: the cell, and the angle to its centroid. at: where the vectors are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, centers.shape[1])
            near = own / np.linalg.norm(own, axis=1, keepdims=True) @ centers.T
            cell = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=[*batch.schema.names, "cell", "angle"])

    return run


class VectorIndex:
    """The index in a folder. Rows have a key `item`, an array `embedding`, and whatever else a search filters by or returns."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def _cells(self, rows: DataFrame, centers: np.ndarray) -> tuple[str, list[float], list[int]]:
        """Rows in a folder of their own, a folder a cell; the largest angle and the number of rows of each cell. A large cell is written by several tasks."""
        path = self.log.fresh("cells")
        ship(self.spark)
        plain = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        placed = plain.mapInArrow(_placed(centers, plain.columns.index("embedding")), f"{schema}, cell int, angle double")
        placed.repartition("cell", F.pmod(F.xxhash64("item"), F.lit(8))).write.partitionBy("cell").parquet(path)
        radius, n = [0.0] * len(centers), [0] * len(centers)
        if rows.isEmpty():
            return path, radius, n
        for r in self.spark.read.parquet(path).groupBy("cell").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():  # a row a cell
            radius[r["cell"]], n[r["cell"]] = r["a"], r["n"]
        return path, radius, n

    def build(self, rows: DataFrame, cells: int | None = None) -> int:
        """Index rows(item, embedding, ...), one part for each length of vectors; gives the version. cells: about the square root of the rows if not given.

        Null, empty and zero vectors, and those with a null or non-finite number, are left out, as a search would leave them out. Rows that share an item stay
        rows of their own. What was in the folder before is replaced.
        """
        fine = rows.where(_fine(F.col("embedding")))
        counts = {r["dims"]: r["n"] for r in fine.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row a length
        parts = {}
        for dims, n in counts.items():
            own = fine.where(F.size("embedding") == dims)
            k = cells or max(1, math.isqrt(n))
            sample = own.select("embedding").orderBy(F.xxhash64("item", "embedding")).limit(k * SAMPLED).toArrow().column("embedding")
            unit = np.array(sample.to_pylist(), float)
            centers = centroids_of(unit / np.linalg.norm(unit, axis=1, keepdims=True), k)
            path, radius, held = self._cells(own, centers)
            parts[str(dims)] = {"centers": centers.tolist(), "segments": [{"path": path, "radius": radius, "rows": held, "seq": 0}]}
        return self.log.commit(lambda old: {"parts": parts, "seq": 0, "gone": []})[0]

    def add(self, rows: DataFrame) -> int:
        """Put more rows into the cells there are; gives the version. Lengths that the index lacks need a build."""
        fine = rows.where(_fine(F.col("embedding")))
        parts = self.log.state()[1].get("parts", {})
        lengths = {str(r[0]) for r in fine.select(F.size("embedding")).distinct().collect()}
        if lengths - set(parts):
            raise ValueError(f"no centroids for vectors of {sorted(lengths - set(parts))} numbers")
        new = {}
        for dims in lengths:
            path, radius, held = self._cells(fine.where(F.size("embedding") == int(dims)), np.array(parts[dims]["centers"]))
            new[dims] = {"path": path, "radius": radius, "rows": held}

        def change(old: dict) -> dict | None:
            if any(old["parts"][d]["centers"] != parts[d]["centers"] for d in new):
                raise ValueError("the index was built anew meanwhile")
            if not new:
                return None
            seq = old["seq"] + 1
            grown = {d: p | {"segments": [*p["segments"], *([new[d] | {"seq": seq}] if d in new else [])]} for d, p in old["parts"].items()}
            return old | {"parts": grown, "seq": seq}

        return self.log.commit(change)[0]

    def remove(self, items: DataFrame) -> int:
        """Rows of items(item) are gone, until they are added again; gives the version. Their cells are not written anew, a build leaves them out."""
        path = self.log.fresh("gone")
        items.select("item").distinct().write.parquet(path)
        return self.log.commit(lambda old: old | {"seq": old["seq"] + 1, "gone": [*old["gone"], {"path": path, "seq": old["seq"] + 1}]})[0]

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None, threshold: float | None = None) -> DataFrame:
        """The k rows of the greatest cosine similarity `score`, ties to the lesser item, with their columns; those that fail `where` never count.

        probes: cells to read; if fewer than k rows pass, twice as many, until k do or all are read. None reads until the result is exact.
        """
        _, state = self.log.state()
        part = state.get("parts", {}).get(str(len(query)))
        asked = np.array(query, float)
        if part is None or not np.isfinite(asked).all() or not asked.any():
            return self._result([], state)
        centers = np.array(part["centers"])
        angle = np.arccos(np.clip(centers @ (asked / np.linalg.norm(asked)), -1, 1))
        rows = np.array([s["rows"] for s in part["segments"]]).sum(0)
        reach = np.cos(np.maximum(0, angle - np.array([s["radius"] for s in part["segments"]]).max(0)))  # no row of a cell is more similar
        order = [int(c) for c in np.argsort(-reach if probes is None else angle, kind="stable") if rows[c]]
        best, done, step = [], 0, probes or FIRST
        while done < len(order):
            best = self._best((part, state["gone"]), order[done : done + step], best, query, k, where, threshold)
            done += step
            step = done  # twice as many in all
            if len(best) == k and (probes is not None or max((reach[c] for c in order[done:]), default=-1) < best[-1]["score"] - ROUNDING):
                break
        return self._result(best, state)

    def _rows(self, part: dict, gone: list[dict]) -> DataFrame:
        """Rows that no later removal has taken."""
        found = [self.spark.read.parquet(s["path"]).withColumn("_seq", F.lit(s["seq"])) for s in part["segments"] if any(s["rows"])]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        for g in gone:
            dead = self.spark.read.parquet(g["path"]).withColumn("_dead", F.lit(g["seq"]))
            out = out.join(dead, "item", "left").where(F.col("_dead").isNull() | (F.col("_seq") > F.col("_dead"))).drop("_dead")
        return out.drop("_seq")

    def _best(self, held: tuple[dict, list[dict]], cells: list[int], best: list, query: list[float], k: int, where: Column | None, threshold: float | None) -> list:
        """The k best of what was found and the rows of some cells, by one pass over these with a top-k a task."""
        rows = self._rows(*held).where(F.col("cell").isin(cells))
        scored = retrieval.vector_scores(rows if where is None else rows.where(where), vectors.literal(query))
        found = retrieval.top(scored.drop("cell", "angle"), "item", k, threshold).collect()
        return sorted([*best, *found], key=lambda r: (-r["score"], r["item"]))[:k]

    def _result(self, best: list, state: dict) -> DataFrame:
        parts = [p for p in state.get("parts", {}).values() if any(any(s["rows"]) for s in p["segments"])]
        if not parts:
            return self.spark.createDataFrame([], "item long, embedding array<double>, score double")
        shown = self._rows(parts[0], []).drop("cell", "angle").withColumn("score", F.lit(0.0))
        return self.spark.createDataFrame(best, shown.schema)


def _fine(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
