"""A table of work that several workers share: claims that exclude each other, and writes that only an owner may do.

Rows lie in buckets of their key, and a version of the log names the folder of each bucket. A change writes the buckets that it touches anew and puts the next version. If
another worker was faster and touched other buckets, the change is put on top of that version as it is; if it touched one of the same, the change
is made again from what there is now. So every change is made to the state right before it, whatever runs at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.operators import state
from fathom.sources.commits import CommitLog, Conflict


class WorkTable:
    """rows(key, status, owner, attempts, ...) in a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 16):
        self.spark, self.key, self.buckets, self.log = spark, key, buckets, CommitLog(spark, folder)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _written(self, rows: DataFrame, buckets: list[int]) -> dict[str, str]:
        """A folder for each bucket; one that is left without rows has none to read."""
        path = self.log.fresh("rows")
        self._bucketed(rows).repartition(max(1, len(buckets)), "_bucket").write.partitionBy("_bucket").parquet(path)
        there = {r[0] for r in self.spark.read.schema("_bucket int").parquet(path).distinct().collect()} if buckets else set()  # at most a row a bucket
        return {str(b): f"{path}/_bucket={b}" if b in there else "" for b in buckets}

    def create(self, rows: DataFrame) -> bool:
        """The first version; False if there is one already."""
        held = {"schema": rows.schema.json(), "buckets": self._written(rows, list(range(self.buckets)))}
        return self.log.put(1, held)

    def _read(self, held: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(held["schema"]))
        paths = [held["buckets"][b] for b in (held["buckets"] if buckets is None else buckets) if held["buckets"][b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        at, held = self.log.state(version)
        if not at:
            raise LookupError("no table")
        return self._read(held)

    def update(self, hit: Column, change: Callable[[DataFrame], DataFrame], tries: int = 50) -> tuple[int, DataFrame]:
        """Make change(rows) of the rows that `hit` selects; gives the version and these rows as they were right before, none if none was hit."""
        for _ in range(tries):
            at, held = self.log.state()
            found = self._bucketed(self._read(held).where(hit)).select("_bucket").distinct().collect()  # at most a row a bucket
            touched = sorted(str(r[0]) for r in found)
            if not touched:
                return at, self._read(held).where("false")
            old = self._read(held, touched)
            new = old.where(~F.coalesce(hit, F.lit(False))).unionByName(change(old.where(hit)))
            written = self._written(new, [int(b) for b in touched])
            base, now = at, held
            while all(now["buckets"][b] == held["buckets"][b] for b in touched):  # nobody has touched the same ones
                if self.log.put(base + 1, now | {"buckets": now["buckets"] | written}):
                    return base + 1, old.where(hit)
                base, now = self.log.state()
        raise Conflict(f"{self.log.folder}: {tries} tries")

    def claim(self, owner: str, among: Column | None = None) -> DataFrame:
        """The pending rows (among those of a condition) that this owner now has: of several who ask at once one gets a row. attempts count the claims."""
        free = F.col("status") == "pending"
        hit = free if among is None else free & among
        _, before = self.update(hit, lambda rows: state.claimed(rows, owner))
        return state.claimed(before, owner)

    def finish(self, owner: str, status: str, among: Column | None = None) -> int:
        """A terminal status for rows that are still this owner's; gives their number, 0 if others have taken them over."""
        mine = (F.col("status") == "indexing") & (F.col("owner") == owner)
        hit = mine if among is None else mine & among
        return self.update(hit, lambda rows: state.finished(rows, owner, status))[1].count()

    def recover(self, alive: DataFrame, most: int = 3) -> int:
        """Rows of owners who are not alive(owner) wait again, or fail after `most` attempts; gives their number."""
        _, before = self.update(F.col("status") == "indexing", lambda rows: state.recovered(rows, alive, most))
        return state.recovered(before, alive, most).where("status <> 'indexing'").count()
