"""Importance resampling of documents towards a target text, by hashed word features.

Features are runs of words, each in one of `buckets` buckets by crc32. A bucket's gain is the log of how much more of the target's
features than of the corpus's fall into it, and a document's weight the mean gain of its features. Documents are drawn
without replacement by the weight and a Gumbel variate of their id.

Features of a batch are interned in an open-addressed table of NumPy arrays: xxhash64 keys, linear probing for all occurrences at
once, and a comparison of the bytes themselves before an occurrence takes a slot. Slots hold a bucket and a count, so crc32
is taken once a distinct feature; an occurrence keeps the number of its slot, by which gains are gathered. Tables
hold at most CHUNK words and their runs, whatever a text's length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

#: Words whose runs are interned together.
CHUNK = 1 << 17
#: Bytes to lower case, and to a space where they are no part of a word: words are of 0-9, a-z and everything beyond ASCII.
CLASSES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; text ends in eight spare bytes."""
    return np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))


def hashes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of text[start : start + size]: all that are shorter than 32 bytes at once, longer ones by the library."""
    lanes = _lanes(text)
    h = _P5 + sizes.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero((sizes >= 8 * (k + 1)) & (sizes < 32))
        lane = _turned(lanes[starts[at] + 8 * k] * _P2, 31) * _P1
        h[at] = _turned(h[at] ^ lane, 27) * _P1 + _P4
    done = sizes & ~7
    at = np.flatnonzero(sizes & 4)
    h[at] = _turned(h[at] ^ ((lanes[starts[at] + done[at]] & _FIRST[4]) * _P1), 23) * _P2 + _P3
    done = sizes & ~3
    for k in range(3):
        at = np.flatnonzero((sizes & 3) > k)
        h[at] = _turned(h[at] ^ (text[starts[at] + done[at] + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(text.data[starts[i] : starts[i] + sizes[i]])
    return h


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether text[a : a + size] and text[b : b + size] are equal, for each pair."""
    lanes = _lanes(text)
    same = np.ones(len(a), bool)
    for k in range(4):
        at = np.flatnonzero(sizes > 8 * k)
        if not len(at):
            break
        differ = (lanes[a[at] + 8 * k] ^ lanes[b[at] + 8 * k]) & _FIRST[np.minimum(sizes[at] - 8 * k, 8)]
        same[at[differ != 0]] = False
    for i in np.flatnonzero(same & (sizes > 32)).tolist():
        same[i] = text.data[a[i] : a[i] + sizes[i]] == text.data[b[i] : b[i] + sizes[i]]
    return same


@dataclass(frozen=True)
class Interned:
    """slots: the slot of each occurrence. By slot, where one is taken: bucket and count."""

    slots: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def intern(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int, keys: np.ndarray | None = None) -> Interned:
    """Intern the spans of text. keys are their hashes; equal hashes of different spans get different slots."""
    keys = hashes(text, starts, sizes) if keys is None else keys
    mask = (1 << max(4, (2 * len(starts) - 1).bit_length())) - 1
    owner = np.full(mask + 1, -1, np.int32)  # the occurrence whose span a slot holds
    slots = (keys & np.uint64(mask)).astype(np.int64)
    left = np.arange(len(starts))
    while len(left):
        at = slots[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]  # of several that claim a slot one gets it
        held = owner[at]
        same = (keys[held] == keys[left]) & (sizes[held] == sizes[left])
        own = np.flatnonzero(same & (held != left))
        same[own] = same_bytes(text, starts[held[own]], starts[left[own]], sizes[left[own]])
        left = left[~same]
        slots[left] = (slots[left] + 1) & mask
    taken = np.flatnonzero(owner >= 0)
    first = owner[taken]
    bucket = np.zeros(mask + 1, np.int32)
    data, crc = text.data, zlib.crc32
    bucket[taken] = [crc(data[a:b]) % buckets for a, b in zip(starts[first].tolist(), (starts + sizes)[first].tolist())]
    return Interned(slots, bucket, np.bincount(slots, minlength=mask + 1))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: the words joined, each followed by one space and all by spare bytes; starts and ends of words; and at which word each text begins, with their number."""
    joined = b" ".join(texts) + b" "
    raw = CLASSES[np.frombuffer(joined, np.uint8)]
    part = raw != 32
    kept = part.copy()
    kept[1:] |= part[:-1]  # the first space after a word
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    before = np.concatenate([[0], np.cumsum(kept)])
    text = np.concatenate([raw[kept], np.zeros(8, np.uint8)])
    ends = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return text, starts, ends, np.searchsorted(starts, before[begins])


def chunks(texts: list[bytes], most: int, buckets: int) -> Iterator[tuple[Interned, np.ndarray, int]]:
    """The runs of 1 to `most` words of texts, interned by the chunk, with the number of the text that each is from, and how many, the first ones, are single words."""
    text, starts, ends, begins = spans(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(begins))
    last = begins[of + 1] if len(of) else of  # the word after a word's text
    for lo in range(0, len(starts), CHUNK):
        word = np.arange(lo, min(lo + CHUNK, len(starts)))
        runs = [word[word + k < last[word]] for k in range(most)]
        first = np.concatenate(runs)
        final = np.concatenate([r + k for k, r in enumerate(runs)])
        at = int(starts[lo])
        own = text[at : int(ends[final.max()]) + 9]
        yield intern(own, starts[first] - at, ends[final] - starts[first], buckets), of[first], len(word)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]


def bucket_counts(rows: DataFrame, most: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all rows by bucket. A task sums up what it reads, so at most `buckets` rows a task are shuffled and `buckets` reach the driver."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for table, _, _ in chunks(_texts(batch), most, buckets):
                taken = np.flatnonzero(table.count)
                total += np.bincount(table.bucket[taken], weights=table.count[taken], minlength=buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share of the target / share of the corpus)) by bucket, one added to each bucket's count."""
    n = len(corpus)
    held, asked = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * held / ((s + 1.0) * asked))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int = 2, keep: list[str] | None = None, into: str = "_weight") -> DataFrame:
    """The columns `keep` of docs (all, if None) with a column `into` of (n_words, n_features, weight): the floored mean of the gains over a text's features, 0 if it has none.

    A null text has no words. Columns may have any name; one called `into` is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for table, of, single in chunks(texts, most, len(shared.value)):
                by_slot = shared.value[table.bucket]
                words += np.bincount(of[:single], minlength=len(texts))
                n += np.bincount(of, minlength=len(texts))
                total += np.bincount(of, weights=by_slot[table.slots], minlength=len(texts)).astype(np.int64)
            figures = [pa.array(x, pa.int64()) for x in (words, n, np.floor_divide(total, np.maximum(n, 1)))]
            found = pa.StructArray.from_arrays(figures, names=["n_words", "n_features", "weight"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "found"])

    own = [c for c in docs.columns if c.lower() != into.lower() and (keep is None or c in keep)]
    rows = docs.select(F.struct(*own).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(run, f"row {kind}, found struct<n_words: bigint, n_features: bigint, weight: bigint>")
    return made.select(*[F.col("row")[c].alias(c) for c in own], F.col("found").alias(into))


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(`seed:doc_id`). A null id is hashed as nothing."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int, among: Column, tie: list[str]) -> DataFrame:
    """scored(score long, ...) with `rank` from 1 for the floor(percent * N / 100) best of the N rows `among`, null for the others.

    Rows are counted by score, and scores are whole numbers within a fixed range (about 170,000), so places follow from a small table: a score
    says how many rows stand above it, and rows of one score are numbered by `tie` on their own. Nothing is sorted in one task.
    """
    counts = scored.where(among).groupBy("score").agg(F.count("*").alias("n"))
    running = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a score
    places = counts.select("score", "n", F.sum("n").over(running).alias("_to"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    taken = places.select("score", (F.col("_to") - F.col("n")).alias("_above"), F.expr(f"_all * {int(percent)} div 100").alias("_most")).where("_above < _most")
    near = scored.withColumn("_among", F.coalesce(among, F.lit(False))).join(F.broadcast(taken), "score", "left")
    chosen = near.where("_among and _above is not null")
    numbered = chosen.withColumn("rank", F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy(*tie)))
    ranked = numbered.withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank")))
    rest = near.where("not _among or _above is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_among", "_above", "_most")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text): score is weight plus a Gumbel variate of doc_id, and the
    floor(percent * N / 100) best of the N rows with `least_words` words are drawn, ranked from 1, ties to the smaller doc_id.

    Null texts have no words and weigh 0; they are never drawn. Of rows that share a doc_id those with fewer features come first on equal scores. A null
    doc_id comes after all others on equal scores. An empty table gives no rows; an empty target or corpus is smoothed like any other. Other columns of docs and target are ignored.
    """
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    found = weights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gain, most, ["doc_id"])
    plain = found.select("doc_id", F.col("_weight.n_words").alias("n_words"), F.col("_weight.n_features").alias("n_features"), F.col("_weight.weight").alias("weight"))
    scored = settle(plain.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")))  # read three times
    ranked = drawn(scored, percent, F.col("n_words") >= least_words, [F.asc_nulls_last("doc_id"), "n_features"])
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")
