"""Line dedup with sharded cuckoo filters backed by exact reference counts.

A line's key is the line with white space stripped at both ends and A-Z lower-cased.
Keys of at least `min_chars` code points found in at least `min_docs` documents
lose their lines everywhere but in the largest doc_id that holds them.

References (key, doc_id) are made distinct and counted per key and slice of documents before a key
reaches its shard, so a line that a third of all documents hold is counted by many tasks and arrives as a row each. A shard is a
cuckoo filter: a key that it has not seen goes into the filter, four bytes, and its reference into the reference table on
disk; a key that it has seen is marked. Exact counts are then kept for marked keys only, and their first
references are fetched from the reference table: lines that stand in one document, nearly all, are never
held exactly or counted. A filter may mark a key wrongly, never miss one, so counts are exact.

`LineIndex` is the incremental form: documents go in and out again. The filters stay per shard, tell which keys of
new documents have no reference yet without a look at the reference table, and give up the
keys whose last reference goes. Verdicts are those of a fresh build over what is left.
"""

from __future__ import annotations

import math
import pickle
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, free_name, passing, settle, ship, shuffle_partitions

#: Slices by which joins on keys are spread.
SLICES = 16
#: Verdicts up to which they are broadcast, about 200 bytes each in a worker.
BROADCAST_KEYS = 250_000
#: Keys that a shard's filter has room for at first; it grows with them.
EXPECTED = 50_000
#: Stands for all null doc_ids; it is never the largest while another holds the line.
NO_ID = -(2**63)


class CuckooFilter:
    """Approximate membership with deletion: 32-bit fingerprints in buckets of four.

    Keys are uint64 hashes; a key's other bucket follows from either bucket and
    the fingerprint. Where an insertion finds no place within max_kicks moves, the table is doubled, so nothing is ever refused: the
    further bits of a bucket's number are told by the fingerprint, so what is in moves without its key, and keys that share
    a fingerprint and a bucket share both buckets at every size. Those beyond the eight places of a fingerprint are counted aside. A key that was inserted n
    times can therefore be deleted n times, and lookups never miss a key that is in.
    """

    SLOTS = 4

    def __init__(self, expected: int = 1024, max_kicks: int = 100):
        self.max_kicks, self.count, self.grown = max_kicks, 0, 0
        self.bits = max(4, math.ceil(math.log2(max(1, expected) / (self.SLOTS * 0.85))))
        self.table = array("I", bytes(4 * self.SLOTS << self.bits))
        self.more: dict[tuple[int, int], int] = {}

    @staticmethod
    def _print(key: int) -> int:
        return (key >> 32) or 1

    @staticmethod
    def _further(print_: int) -> int:
        """The bits that a bucket's number takes from the print, lowest first."""
        mixed = print_ * 0x9E3779B1 & 0xFFFFFFFF
        return mixed ^ mixed >> 16

    def _bucket(self, key: int, print_: int) -> int:
        return key & ((1 << self.bits) - 1) | (self._further(print_) & ((1 << self.grown) - 1)) << self.bits

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & ((1 << self.bits) - 1))

    def _slot(self, key: int) -> int | None:
        print_ = self._print(key)
        a = self._bucket(key, print_)
        for k in (a, self._other(a, print_)):
            cell = self.table[4 * k : 4 * k + 4]
            if print_ in cell:
                return 4 * k + cell.index(print_)
        return None

    def __contains__(self, key: int) -> bool:
        return self._slot(key) is not None

    def insert(self, key: int) -> None:
        self.count += 1
        print_ = self._print(key)
        bucket = self._bucket(key, print_)
        if all(x == print_ for k in (bucket, self._other(bucket, print_)) for x in self.table[4 * k : 4 * k + 4]):
            self.more[self._aside(key)] = self.more.get(self._aside(key), 0) + 1
            return
        while not self._placed(self._bucket(key, print_), print_):
            self._double()

    def _aside(self, key: int) -> tuple[int, int]:
        """What a key shares at every size with those of its print and buckets."""
        print_, low = self._print(key), key & ((1 << self.bits) - 1)
        return print_, min(low, self._other(low, print_))

    def _free(self, bucket: int) -> int | None:
        cell = self.table[4 * bucket : 4 * bucket + 4]
        return 4 * bucket + cell.index(0) if 0 in cell else None

    def _placed(self, bucket: int, print_: int) -> bool:
        """Whether a place was found; if not, nothing has moved."""
        table = self.table
        for k in (bucket, self._other(bucket, print_)):
            if (at := self._free(k)) is not None:
                table[at] = print_
                return True
        moved = []
        for step in range(self.max_kicks):
            at = 4 * k + step % self.SLOTS
            moved.append((at, table[at]))
            table[at], print_ = print_, table[at]
            k = self._other(k, print_)
            if (free := self._free(k)) is not None:
                table[free] = print_
                return True
        for at, print_ in reversed(moved):
            table[at] = print_
        return False

    def _double(self) -> None:
        """Twice the buckets: each goes to itself or, by its prints' next bit, to its double."""
        if self.grown == 32:
            raise OverflowError("a filter of more than 32 doublings")
        old, half = self.table, len(self.table)
        self.table = array("I", bytes(8 * half))
        for at, print_ in enumerate(old):
            if print_:
                self.table[at + half * (self._further(print_) >> self.grown & 1)] = print_
        self.grown += 1

    def delete(self, key: int) -> bool:
        """Whether a fingerprint of the key was there. Delete only keys that were inserted."""
        if (at := self._slot(key)) is None:
            return False
        self.count -= 1
        if left := self.more.pop(self._aside(key), 0):
            if left > 1:
                self.more[self._aside(key)] = left - 1
            return True
        self.table[at] = 0
        return True


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte name of a line's key, or None if the key is too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE).translate(LOWER)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _held(min_chars: int):
    """Rows to (doc_id, mark, key), each key once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, keys = [], [], []
            for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text")):
                own = {line_key(x, min_chars) for x in split_lines(text.as_py())} - {None}
                keys += own
                ids += [NO_ID if doc_id is None else doc_id] * len(own)
                marks += [mark] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "mark", "key"])

    return run


def references(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, mark, key) for each row and key of docs(doc_id, text); mark is a hash of the text. Null ids are NO_ID."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(_held(min_chars), "doc_id long, mark long, key binary")


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little")


def _sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: (key, docs, largest) with `again`, whether the shard's filter had the key or the row stands for several documents."""
    seen = CuckooFilter(EXPECTED)
    for batch in batches:
        again = []
        for key, docs in zip(batch.column("key").to_pylist(), batch.column("docs").to_pylist()):
            short = _short(key)
            known = short in seen
            if not known:
                seen.insert(short)
            again.append(known or docs > 1)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("docs"), batch.column("largest"), pa.array(again, pa.bool_())], names=["key", "docs", "largest", "again"])


def counts(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(key, docs, largest): exact reference counts of every key that two or more documents hold, and of few others."""
    parts = shuffle_partitions(docs.sparkSession)
    sliced = references(docs, min_chars).select("key", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("slice")).repartition(parts, "key", "slice")
    partial = sliced.distinct().groupBy("key", "slice").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest"))
    table = settle(partial.select("key", "docs", "largest").repartition(parts, "key").mapInArrow(_sightings, "key binary, docs long, largest long, again boolean"))
    again, once = table.where("again"), table.where("not again")
    first = once.join(again.select("key").distinct(), "key", "left_semi")
    return again.unionByName(first).groupBy("key").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))


def verdicts(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(key, largest): the keys that lose their lines, and the doc_id that keeps them. Rows of one doc_id are one document."""
    if min_docs < 2:
        raise ValueError("a line needs to stand in two documents at least")
    return counts(docs, min_chars).where(F.col("docs") >= min_docs).select("key", "largest")


def keep_lines(text: str | None, doc_id: int | None, min_chars: int, owner) -> tuple[int, int, bytes]:
    """(lines, dropped, kept text); owner(key) is the doc_id that keeps a key, None if nobody has to lose it."""
    lines, own = split_lines(text), NO_ID if doc_id is None else doc_id
    kept = [x for x in lines if (key := line_key(x, min_chars)) is None or (who := owner(key)) is None or who == own]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


_APPLIED_SQL = "struct<n_lines: bigint, n_dropped: bigint, kept: string>"


def _struct(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"n_lines": [r[0] for r in rows], "n_dropped": [r[1] for r in rows], "kept": [r[2].decode("utf-8", "surrogatepass") for r in rows]})


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_keys: int | None = None, into: str = "_lines") -> DataFrame:
    """docs with a column `into` of (n_lines before dropping, n_dropped, kept text); it takes the place of a column of that name.

    A null or empty text is one empty line and keeps it. Lines whose key is
    shorter than min_chars code points always stay. If all lines go the kept text is empty. Rows that share a doc_id are one document
    and all keep the line of the largest doc_id. All rows with a null doc_id count as one document, which never keeps a line that
    a document with an id holds. Empty input gives empty output; other columns pass through, of any name.
    """
    spark = docs.sparkSession
    bound = BROADCAST_KEYS if broadcast_keys is None else broadcast_keys
    with passing() as tables:
        found = settle(verdicts(docs.select("doc_id", "text"), min_chars, min_docs))
        tables.remove(found)
    if found.count() > bound:
        return _drop_by_join(docs, found, min_chars, into)
    rows = found.toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(rows.column("key").to_pylist(), rows.column("largest").to_pylist())))

    @F.pandas_udf(_APPLIED_SQL)
    def applied(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        owner = shared.value.get
        return _struct([keep_lines(t if isinstance(t, str) else None, None if i is None or i != i else int(i), min_chars, owner) for i, t in zip(ids, texts)])

    # ids travel as text: a column of longs with nulls would turn into doubles
    return docs.withColumn(into, applied(F.col("doc_id").cast("string"), F.col("text")))


def _drop_by_join(docs: DataFrame, found: DataFrame, min_chars: int, into: str) -> DataFrame:
    """The same without a broadcast: a row's lost keys come to it by its doc_id and a hash of its text. A key's rows are spread over slices."""
    held = references(docs.select("doc_id", "text"), min_chars).withColumn("slice", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SLICES)).cast("int"))
    spread = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    lost = held.join(spread, ["key", "slice"]).where("doc_id <> largest").groupBy("doc_id", "mark").agg(F.collect_set("key").alias("lost"))

    @F.pandas_udf(_APPLIED_SQL)
    def applied(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        rows = []
        for t, keys in zip(texts, lost):
            gone = set() if keys is None else {bytes(k) for k in keys}
            rows.append(keep_lines(t if isinstance(t, str) else None, 0, min_chars, lambda k, gone=gone: 1 if k in gone else None))
        return _struct(rows)

    own = [c for c in docs.columns if c.lower() != into.lower()]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"))
    return rows.join(lost, ["doc_id", "mark"], "left").select(*[F.col("row")[c].alias(c) for c in own], applied(F.col("row.text"), F.col("lost")).alias(into))


class LineIndex:
    """Reversible line dedup: documents go in and out, a batch at a time.

    The reference table is a log of Parquet tables in the shared folder, (shard, key, doc_id, sign): a batch that goes in adds +1, one that goes
    out -1 for each of its references, and nothing is rewritten. `filters` has one cuckoo filter a shard that holds each key
    with a reference once. Only touched shards' filters are read and written, and only keys that their
    filter may hold are looked up in the log.
    """

    def __init__(self, spark, shards: int = 64, min_chars: int = 20, min_docs: int = 3):
        ship(spark)
        self.spark, self.shards, self.min_chars, self.min_docs = spark, shards, min_chars, min_docs
        self.log = spark.createDataFrame([], "shard int, key binary, doc_id long, sign int")
        self.filters = spark.createDataFrame([], "shard int, packed binary")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Documents already held (by doc_id) are replaced; null ids are one document."""
        self.delete(docs.select("doc_id"))
        held = references(docs, self.min_chars).select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key", "doc_id").distinct()
        batch = settle(held.withColumn("sign", F.lit(1)))
        keys = batch.select("shard", "key").distinct()
        maybe = settle(self._asked(keys))
        known = self._live(maybe.where("maybe").select("shard", "key"))
        self._change(maybe.select("shard", "key").join(known, ["shard", "key"], "left_anti"), CuckooFilter.insert)
        self.log = self.log.unionByName(batch)
        return self

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes out what the documents of these doc_ids hold; unknown ids are no matter."""
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        held = self.log.join(gone, "doc_id", "left_semi").groupBy("shard", "key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
        batch = settle(held.select("shard", "key", "doc_id", F.lit(-1).alias("sign")))
        self.log = self.log.unionByName(batch)
        keys = batch.select("shard", "key").distinct()
        self._change(keys.join(self._live(keys), ["shard", "key"], "left_anti"), CuckooFilter.delete)
        return self

    def _live(self, keys: DataFrame) -> DataFrame:
        """Those of the keys that have a reference."""
        return self.log.join(keys, ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.sum("sign").alias("n")).where("n > 0").select("shard", "key")

    def _asked(self, keys: DataFrame) -> DataFrame:
        """(shard, key, maybe): what the filters say about keys."""

        def ask(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            known = pickle.loads(held.packed.iloc[0]) if len(held) else CuckooFilter(16)
            return keys[["shard", "key"]].assign(maybe=[_short(bytes(k)) in known for k in keys.key])

        return self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(ask, "shard int, key binary, maybe boolean")

    def _change(self, keys: DataFrame, how) -> None:
        """Insert keys into, or delete them from, the filters of their shards."""
        keys = settle(keys)
        touched = keys.select("shard").distinct()

        def change(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            known = pickle.loads(held.packed.iloc[0]) if len(held) else CuckooFilter()
            for k in keys.key:
                how(known, _short(bytes(k)))
            return pd.DataFrame({"shard": keys.shard.iloc[:1], "packed": [pickle.dumps(known)]})

        changed = self.filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(change, "shard int, packed binary")
        self.filters = settle(self.filters.join(touched, "shard", "left_anti").unionByName(changed))

    def counts(self) -> DataFrame:
        """(key, docs, largest): the exact reference counts of all keys."""
        live = self.log.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
        return live.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest"))

    def verdicts(self) -> DataFrame:
        """(key, largest), as verdicts() over the documents that are in."""
        return self.counts().where(F.col("docs") >= self.min_docs).select("key", "largest")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with each text cut to its kept lines; n_chars, if there is one, follows. A null text becomes empty."""
    into = free_name(docs, "_lines")
    done = drop_lines(docs, min_chars, min_docs, into=into)
    kept = F.col(into)["kept"]
    return done.select(*[kept.alias(c) if c == "text" else F.char_length(kept).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
