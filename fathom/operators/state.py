"""State transitions as pure functions, old rows to new rows; writing them is the caller's."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; partly reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_r"))).alias("_m")).select(key, *[f"_m.{c}" for c in order], *[f"_m._r.{c}" for c in rest])


def upserted(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of new rows of one key the last counts, by `order` and then all columns."""
    rest = [c for c in new.columns if c != key]
    by = [*(order or []), *[c for c in rest if c not in (order or [])]]
    one = new.groupBy(key).agg(F.max(F.struct(*by)).alias("_m")).select(*[key if c == key else F.col("_m")[c].alias(c) for c in new.columns]) if by else new.distinct()
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def retried(rows: DataFrame, owner: str, most: int = 3) -> DataFrame:
    """After a storage error of `owner`: its rows that have attempts left wait again without an owner, the others fail; rows of other owners stay."""
    mine = F.coalesce((F.col("status") == "indexing") & (F.col("owner") == owner), F.lit(False))
    again = mine & (F.col("attempts") < most)
    return rows.withColumns({"status": F.when(again, "pending").when(mine, "failed").otherwise(F.col("status")), "owner": F.when(~again, F.col("owner"))})


def enriching(rows: DataFrame, owner: str) -> DataFrame:
    """Claim of an enrichment: rows that are not already being enriched get this owner, and keep the status they had as `prior`."""
    free = F.coalesce(F.col("status") != "enriching", F.lit(True))
    return rows.withColumns({"prior": F.when(free, F.col("status")).otherwise(F.col("prior")), "owner": F.when(free, owner).otherwise(F.col("owner")), "status": F.lit("enriching")})


def work_set(items: DataFrame, results: DataFrame, item: str, choice: str) -> DataFrame:
    """Items to enrich: all; unenriched, those without a row of results(item, error); failed, those with an error."""
    if choice == "all":
        return items
    if choice == "unenriched":
        return items.join(results.select(item), item, "left_anti")
    if choice == "failed":
        return items.join(results.where(F.col("error").isNotNull()).select(item), item, "left_semi")
    raise ValueError(f"unknown choice {choice!r}")


def work_sets(items: DataFrame, results: DataFrame, item: str) -> DataFrame:
    """items with `choice` for each of the sets that they belong to, by one join: all, unenriched, failed."""
    found = results.groupBy(item).agg(F.max(F.col("error").isNotNull()).alias("_failed"))
    met = items.join(found, item, "left")
    sets = F.array(F.lit("all"), F.when(F.col("_failed").isNull(), "unenriched").when(F.col("_failed"), "failed"))
    return met.select(*items.columns, F.explode(F.array_compact(sets)).alias("choice"))


def cascade(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of what is gone(key)."""
    ids = gone.select(key).distinct()
    return {name: rows.join(ids, key, "left_anti").select(*rows.columns) for name, rows in children.items()}


def prunable(known: DataFrame, fresh: DataFrame, reachable: list[str]) -> DataFrame:
    """known(key) that are not fresh(key), within the prefixes (`prefix:...`) that were reached and gave something this time; others are never touched."""
    prefix = F.substring_index("key", ":", 1)
    given = fresh.select(prefix.alias("_p")).where(F.col("_p").isin(reachable)).distinct()
    return known.withColumn("_p", prefix).where(F.col("key").contains(":")).join(F.broadcast(given), "_p", "left_semi").join(fresh.select("key"), "key", "left_anti").select("key")


def claimed(rows: DataFrame, owner: str) -> DataFrame:
    """pending becomes indexing with one attempt more; all else stays."""
    open_ = F.col("status") == "pending"
    return rows.withColumns({"status": F.when(open_, "indexing").otherwise(F.col("status")), "attempts": F.when(open_, F.col("attempts") + 1).otherwise(F.col("attempts")), "owner": F.when(open_, owner).otherwise(F.col("owner"))})


def finished(rows: DataFrame, owner: str, status: str) -> DataFrame:
    """A terminal write: only rows still indexing under this owner change."""
    mine = (F.col("status") == "indexing") & (F.col("owner") == owner)
    return rows.withColumn("status", F.when(mine, status).otherwise(F.col("status")))


def recovered(rows: DataFrame, alive: DataFrame, most: int = 3) -> DataFrame:
    """Rows indexing under an owner who is not alive(owner): exhausted ones fail, the others wait again."""
    marked = rows.join(alive.select("owner").distinct().withColumn("_alive", F.lit(True)), "owner", "left")
    lost = (F.col("status") == "indexing") & F.col("_alive").isNull()
    return marked.withColumn("status", F.when(lost & (F.col("attempts") >= most), "failed").when(lost, "pending").otherwise(F.col("status"))).select(*rows.columns)


def refresh_plan(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Both (key, hash) to (key, action): new, changed, unchanged or stale."""
    a, b = incoming.select("key", F.col("hash").alias("_a"), F.lit(1).alias("_x")), known.select("key", F.col("hash").alias("_b"), F.lit(1).alias("_y"))
    action = F.when(F.col("_y").isNull(), "new").when(F.col("_x").isNull(), "stale").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, "key", "full").select("key", action.alias("action"))


def index_status(indexed: Column, current: Column) -> Column:
    """Nothing to index: null; never built: absent; other count: stale; else ready."""
    return F.when(F.coalesce(current, F.lit(0)) == 0, None).when(indexed.isNull(), "absent").when(indexed != current, "stale").otherwise("ready")


def fixed_window(rows: DataFrame, key: str, at: str, order: str, limit: int, unit: str = "minute") -> DataFrame:
    """`accepted` for the first `limit` rows of a key in each unit of time."""
    place = F.row_number().over(Window.partitionBy(key, F.date_trunc(unit, at)).orderBy(at, order))
    return rows.withColumn("accepted", place <= limit)


def sliding_window(rows: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """(key, order, accepted): greedy; a row counts if fewer than `limit` accepted ones of its key lie in the `seconds` before it.

    Rows stream through in order of time; a task holds `limit` times of one key, whatever the group's size.
    """
    kind, kind2 = dict(rows.dtypes)[key], dict(rows.dtypes)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["_t"]):
                if k != now:
                    now, held = k, deque()
                while held and held[0] <= t - seconds * 1_000_000:
                    held.popleft()
                ok = len(held) < limit
                if ok:
                    held.append(t)
                out.append(ok)
            yield pd.DataFrame({key: batch[key], order: batch[order], "accepted": out})

    slim = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    return slim.repartition(key).sortWithinPartitions(key, "_t", order).mapInPandas(run, f"{key} {kind}, {order} {kind2}, accepted boolean")


def first_of_content(rows: DataFrame, item: str, content: Column) -> DataFrame:
    """(item, content_hash): the least item of each content."""
    return rows.groupBy(F.sha2(content.cast("binary"), 256).alias("content_hash")).agg(F.min(item).alias(item))


def timed_out(rows: DataFrame, at: str, now: Column, minutes: int = 10) -> DataFrame:
    """Runs indexing since more than so many minutes have failed."""
    old = F.col(at) < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return rows.withColumn("status", F.when((F.col("status") == "indexing") & old, "failed").otherwise(F.col("status")))
