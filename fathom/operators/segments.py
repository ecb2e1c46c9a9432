"""A sparse index that takes and gives up items without being rebuilt: segments, tombstones and a log of versions.

A segment has the postings of the items that were added together, in buckets of terms, with their totals. Removing items writes a tombstone for each: the
item, and the number of the change. A posting counts if its item has no tombstone of a later change than its segment, so an item that comes again is one
of the new segment. Each change puts one version of the log, which names the segments and tombstones it consists of; readers keep the version that they opened.

Segments are merged when FANOUT of about one size have come together, or when many items are dead: postings of live items are written anew, in one segment,
and tombstones that no segment needs any more are left behind. A change reads the items' own bucket, never the texts of other items.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import sparse
from fathom.sources.commits import CommitLog

#: Segments of one size before they are merged; share of dead items at which all are.
FANOUT, DEAD = 4, 0.25

_TOTALS = "kb string, item_count long, tokens long"


def _tier(items: int) -> int:
    return int(math.log(max(items, 1), FANOUT))


class SegmentedIndex:
    """The index in a folder. item is the type of the items' ids."""

    def __init__(self, spark: SparkSession, folder: str, item: str = "long", stemmer: str | None = None, stop_words: list[str] | None = None):
        self.spark, self.item, self.stemmer, self.stop_words = spark, item, stemmer, stop_words
        self.log = CommitLog(spark, folder)

    # -- reading -----------------------------------------------------------------

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"kb string, term string, item {self.item}, tf long, n long, bucket int").parquet(path)

    def _marks(self, path: str) -> DataFrame:
        """The rows of a segment that stand for its items."""
        return self._read(path).where((F.col("bucket") == sparse.bucket_of("")) & (F.col("term") == ""))

    def _segments(self, state: dict) -> DataFrame:
        """All postings with the number of the change that wrote them."""
        found = [self._read(s["path"]).withColumn("seq", F.lit(s["seq"])) for s in state.get("segments", [])]
        if not found:
            return self.spark.createDataFrame([], f"kb string, term string, item {self.item}, tf long, n long, bucket int, seq int")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def _dead(self, state: dict) -> DataFrame | None:
        """(item, dead): the last change that removed an item."""
        found = [self.spark.read.schema(f"item {self.item}").parquet(t["path"]).withColumn("seq", F.lit(t["seq"])) for t in state.get("tombstones", [])]
        if not found:
            return None
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.groupBy("item").agg(F.max("seq").alias("dead"))

    def _live(self, state: dict, where: Column | None = None) -> DataFrame:
        rows = self._segments(state)
        rows = rows if where is None else rows.where(where)
        dead = self._dead(state)
        if dead is not None:
            rows = rows.join(dead, "item", "left").where("dead is null or seq > dead").drop("dead")
        return rows.select("bucket", "kb", "term", "item", "tf", "n")

    def _items(self, state: dict) -> DataFrame:
        """(kb, item, n) of live items: they have a row with the empty term, in one bucket."""
        return self._live(state, (F.col("bucket") == sparse.bucket_of("")) & (F.col("term") == "")).select("kb", "item", "n")

    def open(self, version: int | None = None) -> sparse.Index | None:
        """The index as of a version, the newest if none is named; None before the first."""
        at, state = self.log.state(version)
        if not at:
            return None
        counts = [self.spark.read.schema(_TOTALS).parquet(s["totals"]) for s in state["changes"]]
        totals = counts[0]
        for c in counts[1:]:
            totals = totals.unionByName(c)
        totals = totals.groupBy("kb").agg(F.sum("item_count").alias("item_count"), F.sum("tokens").alias("tokens")).where("item_count > 0")
        return sparse.Index(self._live(state), totals.withColumn("built_at", F.lit(state["built_at"]).cast("timestamp")))

    # -- changing ------------------------------------------------------------------

    def _written(self, rows: DataFrame, parts: int) -> tuple[str, int]:
        """Postings in a folder of their own, and their items."""
        path = self.log.fresh("segment")
        sparse.write_postings(rows, path, parts)
        return path, self._marks(path).count()

    def _counted(self, items: DataFrame, sign: int = 1) -> str:
        """The totals of a change, as a table: more or fewer items and tokens by knowledge base."""
        path = self.log.fresh("totals")
        one = items.groupBy("kb").agg((F.count("*") * sign).cast("long").alias("item_count"), (F.sum("n") * sign).cast("long").alias("tokens"))
        one.coalesce(1).write.parquet(path)
        return path

    def _stamped(self, state: dict) -> dict:
        return state | {"built_at": str(self.spark.sql("select current_timestamp()").first()[0])}

    def build(self, docs: DataFrame, item: str, body: str | Column, kb: str | None = None) -> sparse.Index:
        """The index, of these documents if there is none yet. Where several build it at once one of them counts, and the others' files go."""
        if not self.log.version():
            rows = sparse.postings(docs, item, body, kb, self.stemmer, self.stop_words).withColumn("item", F.col("item").cast(self.item))
            parts = sparse.parts_of(docs, body)
            path, n = self._written(rows, parts)
            state = {"seq": 1, "segments": [{"path": path, "seq": 1, "items": n, "parts": parts}]}
            state["changes"] = [{"totals": self._counted(self._items(state))}]
            if not self.log.put(1, self._stamped(state)):
                self.log.delete(path)
        return self.open()

    def add(self, docs: DataFrame, item: str, body: str | Column, kb: str | None = None) -> int:
        """Add documents; those whose item is in the index take its place. An item is in docs once. Gives the version."""
        rows = sparse.postings(docs, item, body, kb, self.stemmer, self.stop_words).withColumn("item", F.col("item").cast(self.item))
        parts = sparse.parts_of(docs, body)
        path, n = self._written(rows, parts)
        if not n:
            self.log.delete(path)
            return self.log.version()
        new = self._marks(path)

        def change(old: dict) -> dict:
            seq = old.get("seq", 0) + 1
            gone = self._removed(old, new.select("item"), seq - 1) if old.get("segments") else {}
            changes = [*old.get("changes", []), *gone.get("changes", []), {"totals": self._counted(new)}]
            segments = [*old.get("segments", []), {"path": path, "seq": seq, "items": n, "parts": parts}]
            return self._stamped(old | {"seq": seq, "segments": segments, "tombstones": gone.get("tombstones", old.get("tombstones", [])), "dead": old.get("dead", 0) + gone.get("n", 0), "changes": changes})

        at, state = self.log.commit(change)
        return self.merge() if self._due(state) else at

    def _removed(self, old: dict, items: DataFrame, seq: int) -> dict:
        """Tombstones for those of items(item) that are live, which go no further than change seq, and their totals. Reads one bucket."""
        path = self.log.fresh("tombstones")
        hit = self._items(old).join(items.distinct(), "item", "left_semi")
        hit.write.parquet(path)
        found = self.spark.read.schema(hit.schema).parquet(path)
        n = found.count()
        if not n:
            self.log.delete(path)
            return {}
        return {"tombstones": [*old.get("tombstones", []), {"path": path, "seq": seq}], "n": n, "changes": [{"totals": self._counted(found, -1)}]}

    def remove(self, items: DataFrame) -> int:
        """Remove items(item); unknown ones change nothing. Gives the version."""
        ids = items.select(F.col("item").cast(self.item).alias("item"))

        def change(old: dict) -> dict | None:
            if not old.get("segments"):
                return None
            seq = old["seq"] + 1
            gone = self._removed(old, ids, seq)
            if not gone:
                return None
            return self._stamped(old | {"seq": seq, "tombstones": gone["tombstones"], "dead": old.get("dead", 0) + gone["n"], "changes": [*old["changes"], *gone["changes"]]})

        at, state = self.log.commit(change)
        return self.merge() if self._due(state) else at

    def _due(self, state: dict) -> list[dict]:
        """The segments to merge: all if many of their items are dead, else those of a size of which there are FANOUT."""
        segments = state.get("segments", [])
        if state.get("dead", 0) > DEAD * max(1, sum(s["items"] for s in segments)):
            return segments
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(_tier(s["items"]), []).append(s)
        return next((found for found in tiers.values() if len(found) >= FANOUT), [])

    def merge(self, everything: bool = False) -> int:
        """Write the live postings of the segments that are due (or all) as one, and leave tombstones behind that no other segment needs. Results stay the same."""

        def change(old: dict) -> dict | None:
            due = old.get("segments", []) if everything else self._due(old)
            if not due:
                return None
            live = self._live(old | {"segments": due})
            parts = sum(s.get("parts", 1) for s in due)
            path, n = self._written(live, parts)
            rest = [s for s in old["segments"] if s not in due]
            new = [{"path": path, "seq": old["seq"], "items": n, "parts": parts}] if n else []  # all of it is live as of now
            least = min((s["seq"] for s in rest), default=math.inf)
            kept = [t for t in old.get("tombstones", []) if t["seq"] >= least]  # the others hide nothing that is left
            changes = [{"totals": self._counted(self._items(old))}]
            dead = 0 if not rest else max(0, old.get("dead", 0) - (sum(s["items"] for s in due) - n))
            return self._stamped(old | {"segments": [*rest, *new], "tombstones": kept, "dead": dead, "changes": changes})

        return self.log.commit(change)[0]
