"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. At each level

* a run of equal names becomes one name (so neighbours differ),
* deterministic coin tossing labels the sequence: a name's label is twice the lowest bit at which it
  differs from its left neighbour, plus that bit; four rounds bring 64-bit names down to six labels,
  neighbours always differing,
* phrases begin at local maxima of the labels, two to eleven names long inside a text, and a
  phrase's hash is its name on the next level.

Where a phrase begins depends on a few neighbours only, so equal substrings
are parsed alike inside, wherever they stand. The fingerprint holds a bottom-k
sketch of the phrase names of each of three levels (phrases of some 7, 20 and 50
characters). All steps run on whole batches of texts at once; texts never share a phrase.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, ship, shuffle_partitions

#: Level, names kept, weight in a likeness.
LEVELS = ((2, 16, 1), (3, 32, 2), (4, 16, 1))
#: Code points parsed at a time.
BATCH = 150_000

_DE_BRUIJN = 0x03F79D71B4CB0A89
_PLACE = np.zeros(64, np.uint8)
for _i in range(64):
    _PLACE[((_DE_BRUIJN << _i) & (2**64 - 1)) >> 58] = _i


def _toss(a: int, left: int) -> int:
    x = a ^ left
    low = (x & -x).bit_length() - 1
    return 2 * low + (a >> low & 1)


_LABEL = np.array([[_toss(a, b) if a != b else 0 for b in range(128)] for a in range(128)], np.uint8).ravel()


def _phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin; neighbours within a text differ, `first` marks the first name of each text."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    x = names ^ left
    low = x & (~x + np.uint64(1))
    place = _PLACE[(low * np.uint64(_DE_BRUIJN)) >> np.uint64(58)]
    label = 2 * place + ((names >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        pair = label.astype(np.uint16) << np.uint16(7)
        pair[1:] |= label[:-1]
        pair[first] = (label[first].astype(np.uint16) << np.uint16(7)) | (label[first] ^ 1)
        label = _LABEL.take(pair)
    rises = np.empty(len(label) + 1, bool)
    rises[0] = rises[-1] = False
    np.greater(label[1:], label[:-1], out=rises[1:-1])
    tops = rises[:-1] & ~rises[1:]
    # a text's first name begins a phrase; so does its last if it rises, whatever text follows
    last = np.flatnonzero(first)[1:] - 1
    tops[last] = rises[last] & ~first[last]
    tops[first] = True
    return tops


#: An odd factor for each place in a phrase.
_FACTOR = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POINT = mix(np.arange(1, 0x10000, dtype=np.uint64))


def _level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: phrase names, and the text each belongs to."""
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    runs = first.copy()
    runs[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(runs)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    own, first = owner[at], first[at]
    names = names[at]
    longer = length > 1
    if longer.any():
        names = names.copy()
        names[longer] = mix(names[longer] ^ (length[longer] * np.uint64(0xD1B54A32D192ED03)))
        # a run's new name may equal its neighbour's only by a 64-bit collision; then the later one moves on
        same = np.flatnonzero((names[1:] == names[:-1]) & ~first[1:]) + 1
        names[same] += np.uint64(1)
    at = np.flatnonzero(_phrases(names, first))
    inside = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    return mix(np.add.reduceat(names * _FACTOR.take(inside), at)), own[at]


def sketches(texts: list[str]) -> list[str]:
    """The fingerprint of each text: per level its smallest phrase names, eight hex digits each, levels parted by '-'. Empty for an empty text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = [len(p) for p in points]
    parts: list[list[str]] = [[] for _ in texts]
    if not sum(sizes):
        return ["" for _ in texts]
    points = np.concatenate(points)
    names = _POINT.take(points) if points.max() < len(_POINT) else mix(points.astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = {level: k for level, k, _ in LEVELS}
    for level in range(1, max(kept) + 1):
        names, owner = _level(names, owner)
        if level not in kept:
            continue
        short = mix(names ^ np.uint64(level)) >> np.uint64(32)
        both = np.unique(owner.astype(np.uint64) << np.uint64(32) | short)
        whose, value = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
        cut = np.searchsorted(whose, np.arange(len(texts) + 1))
        for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if hi > lo:
                parts[k].append(value[lo : min(hi, lo + kept[level])].astype(">u4").tobytes().hex())
    return ["-".join(p) for p in parts]


def likeness(a: str, b: str) -> float:
    """0 to 1: the estimated share of common phrases (2 |A and B| / (|A| + |B|)), averaged over the levels. Two empty fingerprints are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    total = weights = 0.0
    for (_, k, weight), x, y in zip(LEVELS, a.split("-"), b.split("-")):
        left, right = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
        least = sorted(left | right)[:k]
        j = sum(v in left and v in right for v in least) / len(least)
        total += weight * 2 * j / (1 + j)
        weights += weight
    return total / weights


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null texts count as empty, repeats and null ids are kept."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            found: list[str] = []
            for lo, hi in _cuts([len(t) for t in texts]):
                found += sketches(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield lo, len(sizes)


def in_order(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt into buckets of descending doc_id, each followed by the first row of the next bucket (the last by
    the first of all), sorted: bucket, extra, doc_id, text. One shuffle; the bucket bounds are a bounded list of ids. An id that many rows share
    is dealt into buckets of its own by its texts' hashes."""
    parts = 4 * shuffle_partitions(docs.sparkSession)
    key = F.xxhash64("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("at"), key.alias("h"))
    bounds = Counter(rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])
    most = max(bounds.values(), default=1)  # bounds that fall on one id
    bucket = F.lit(0)
    if bounds:
        bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("at"))) * most
        shared = {b: n for b, n in bounds.items() if n > 1}
        for b, n in shared.items():  # the greatest hashes first
            bucket = bucket + F.when(F.col("at") == b, F.floor((0.5 - F.col("h") / 2.0**64) * n)).otherwise(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # the first row of each bucket in the order below: greatest id, then the text's hash
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("at", "h")).alias("f")).orderBy("bucket").collect()
    if not firsts:
        return rows.select("bucket", F.lit(False).alias("extra"), "doc_id", "text")
    goes = {(r.f.at, r.f.h): firsts[i - 1].bucket for i, r in enumerate(firsts)}  # index -1: around the end
    listed = F.broadcast(docs.sparkSession.createDataFrame([(a, h, b) for (a, h), b in goes.items()], "at long, h long, also int"))
    first = rows.join(listed, ["at", "h"], "left")
    both = first.withColumn("x", F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("e")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("e")), F.struct(F.col("also").alias("b"), F.lit(True).alias("e"))))))
    flat = both.select(F.col("x.b").alias("bucket"), F.col("x.e").alias("extra"), "doc_id", "at", "h", "text")
    return flat.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.desc("at"), F.desc("h")).select("bucket", "extra", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id, after the last the
    first; a single document follows itself. Rows that share a doc_id are ordered by their text's hash; null ids come last.
    A null text is empty; its fingerprint is empty. Other columns are ignored.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        """rows: of one bucket and in order; the last is only there to follow."""
        texts = [r[1] for r in rows]
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = sketches(texts)
        of_new = sketches(new)
        n = len(new)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows[:n]], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
            pa.array(prints[:n], pa.string()),
            pa.array(of_new, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints, of_new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, size = None, 0
        for batch in batches:
            for b, extra, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                if b != bucket:
                    held, bucket, size = [], b, 0
                if extra and held and held[-1] is None:
                    continue  # several rows tie for the first of the next bucket: one follows
                text = text.as_py()
                held.append((doc_id, text))
                size += len(text)
                if extra or size > BATCH and len(held) > 1:
                    if len(held) > 1:
                        yield out(held)
                    held, size = ([None], 0) if extra else ([held[-1]], len(text))

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
