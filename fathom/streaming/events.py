"""Structured Streaming over append-only event ledgers: bounded state, late rows dropped behind a watermark."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fathom.session import ship
from fathom.sources.commits import CommitLog

#: Widths of the rollup's buckets by name; another name has no buckets.
STORE = "spark.sql.streaming.stateStore.providerClass"
UNITS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def ledger(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files that arrive in a folder; a batch reads a bounded number of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def buckets(events: DataFrame, unit: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(bucket, runs, failed, tokens, last_run) of closed buckets; rows later than `delay` are left out. Works on batches too."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    rolled = timed.groupBy(F.window(at, UNITS[unit]).alias("_w")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum("value").alias("tokens"), F.max(at).alias("last_run"))
    return rolled.select(F.col("_w.start").alias("bucket"), "runs", "failed", "tokens", "last_run")


def once(events: DataFrame, key: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key, as long as repeats come within `delay`."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


class Limiter(StatefulProcessor):
    """Judges the rows (limited_us, order) of a key. Its state is a list of the times of the accepted rows that still matter, and a timer that clears it."""

    def __init__(self, key: str, order: str, limit: int, seconds: int):
        self.key, self.order, self.limit, self.micros = key, order, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = sorted(x for part in rows for x in zip(part["limited_us"].tolist(), part[self.order].tolist()))  # two numbers a row of this trigger
        held = deque(x[0] for x in self.held.get())
        accepted = []
        for t, _ in found:
            while held and held[0] <= t - self.micros:
                held.popleft()
            accepted.append(len(held) < self.limit)
            if accepted[-1]:
                held.append(int(t))
        self.held.put([(t,) for t in held])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max((held[-1] if held else 0) + self.micros, timerValues.getCurrentWatermarkInMs() * 1000) // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(found), self.order: [x[1] for x in found], "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, order: str, limit: int, seconds: int, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, order, accepted) of a stream: a row counts if fewer than `limit` accepted ones of its key lie in the `seconds` before it.

    The state of a key is the times of the accepted rows that still matter, `limit` at most; a timer clears it once the watermark has passed them. Rows of one trigger
    are taken in order of time; a row older than what earlier triggers accepted is judged by what is held. Rows without key or time are left out, as are those that
    are late by more than `delay`. State is kept in RocksDB, so it may exceed memory; the setting is made where the session has none of its own.
    """
    spark = events.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind, kind2 = dict(events.dtypes)[key], dict(events.dtypes)[order]
    slim = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, order, F.col(at).cast("timestamp").alias("limited_at")).withWatermark("limited_at", delay).withColumn("limited_us", F.unix_micros("limited_at"))
    return slim.groupBy(key).transformWithStateInPandas(Limiter(key, order, limit, seconds), f"{key} {kind}, {order} {kind2}, accepted boolean", "append", "EventTime")


class Ticks:
    """What a stream writes batch by batch, each once: a batch's rows lie in a folder of their own and count when the log has the version of the batch's number.

    A batch that comes again, after a restart or a lost driver, finds its version and writes nothing; one that was cut off before leaves a folder that nobody reads.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), CommitLog(spark, folder)

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch; False if it was there."""
        if self.log.version() > batch:
            return False
        path = self.log.fresh("batch")
        rows.write.parquet(path)
        _, before = self.log.state(batch)
        done = self.log.put(batch + 1, {"paths": [*before.get("paths", []), path], "schema": rows.schema.json()})
        if not done:
            self.log.delete(path)
        return done

    def start(self, rows: DataFrame, every: str | None = None) -> StreamingQuery:
        """Write what arrives `every` so often; without it, what has arrived, and stop. The checkpoint lies in the folder."""
        when = {"processingTime": every} if every else {"availableNow": True}
        out = rows.writeStream.foreachBatch(lambda df, batch: self.write(df, batch) and None)
        return out.option("checkpointLocation", f"{self.folder}/_checkpoint").trigger(**when).start()

    def rows(self) -> DataFrame | None:
        """All rows of the batches that count; None before the first."""
        at, held = self.log.state()
        return self.spark.read.schema(T.StructType.fromJson(json.loads(held["schema"]))).parquet(*held["paths"]) if at else None


def append(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived and stop; a rerun with the same checkpoint goes on from there, each row once."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
