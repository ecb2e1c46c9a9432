"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

A key's score for a shard is -weight / ln(u), u in (0, 1) from a hash of key and shard; the shard with the
highest score holds the key. A shard's score never depends on the other shards, so one more shard only takes
keys that it now scores highest for, and all other keys stay. With equal
weights the highest hash decides, which is the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard that are numbered by one task.
ROWS = 100_000


def rendezvous(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard, 0 to shards - 1, of a key. A null key is a key of its own."""
    if shards < 1 or weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("shards needs to be positive, with one positive weight each")
    name = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    if weights is None:
        tried = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(name, s).alias("score"), (-s).alias("s")))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
        unit = lambda x: (F.shiftrightunsigned(F.xxhash64(name, x["s"]), 11).cast("double") + 0.5) / float(1 << 53)
        tried = F.transform(each, lambda x: F.struct((-x["w"] / F.log(unit(x))).alias("score"), (-x["s"]).alias("s")))
    return (-F.array_max(tried)["s"]).cast("int")


def numbered(rows: DataFrame, shard: str, order: list[str], shards: int, ranges: int | None = None) -> DataFrame:
    """rows with `slot`, gapless from 0 within each shard.

    A shard is cut into ranges by a hash of the order columns, of some ROWS rows each if shards are alike; ranges are counted first (shards x
    ranges numbers, a table of a ROWSth of the rows) and numbered side by side, so no shard is sorted by one task.
    """
    if ranges is None:
        ranges = max(64, -(-rows.count() // (ROWS * shards)))
    dealt = rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(shard, "_range").agg(F.count("*").alias("_n"))
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(shard, "_range").orderBy(*order)
    placed = dealt.withColumn("_row", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(firsts), [shard, "_range"]).withColumn("slot", (F.col("_first") + F.col("_row")).cast("long")).drop("_range", "_first", "_row")


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16; a null text has none and the crc of no
    bytes, 0. law is 'key': doc_id and the number of shards decide. grown_shard: the shard with one more
    shard (of weight 1, or of the mean weight). Rows with one doc_id, or null ones, share a shard and differ in slot.
    Other columns are ignored; empty input gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    grown = None if weights is None else [*weights, sum(weights) / len(weights)]
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col("doc_id"), shards, weights)).withColumn("grown_shard", rendezvous(F.col("doc_id"), shards + 1, grown))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
