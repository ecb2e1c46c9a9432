"""Importance resampling: the table against plain dictionaries, whole results against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from fathom.llm import resampling

HOSTILE = "doc_id long, text string, score string, rank string, _weight int, n string, row string, item_id int"


def brute(docs, target, percent=25, least=20):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    runs = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in side for f in runs(words(x))) for side in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        w = words(text)
        own = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(bucket, runs(w))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    among = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(among[: percent * len(among) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def documents(seed=1, n=120):
    rng = random.Random(seed)
    some = ["Alpha", "beta", "x1", "éÀ", "日本語" * 12, "a-b", "Z_z", "1,000", "c" * 70, "\x7f", "\t", "ß"]
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 25, 90])))) for i in range(n)]
    rows += [(3, rows[3][1]), (3, "twenty " * 25), (None, "nobody " * 30), (None, "nobody " * 30), (None, None), (200, None), (201, ""), (202, "-- !?"), (203, "long Text " * 9000)]
    return rows


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 64)
    rows, target = documents(), ["alpha beta x1", None, "", "éÀ Alpha twenty twenty"]
    docs = spark.createDataFrame([(i, t, "s", "r", 1, "n", "w", 2) for i, t in rows], HOSTILE)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    got = resampling.resample(docs, bench)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, target), key=str)


@pytest.mark.parametrize("rows, target", [([], ["a b"]), ([(1, "a " * 30)], []), ([], []), ([(1, None)], [None])])
def test_empty_sides(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(map(tuple, resampling.resample(docs, bench).collect())) == sorted(brute(rows, target))


def test_equal_scores_go_by_id(spark):
    rows = spark.createDataFrame([(i, 5 if i < 90 else 7, 1) for i in range(100)], "doc_id long, score long, n_features long")
    got = resampling.drawn(rows, 25, resampling.F.lit(True), ["doc_id"]).where("rank is not null")
    assert sorted((r["rank"], r.doc_id) for r in got.collect()) == [(k + 1, i) for k, i in enumerate([*range(90, 100), *range(15)])]


def spans_of(words):
    text = np.frombuffer(b" ".join(words) + b" " + bytes(8), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return text, starts, sizes


def test_hashes_equal_the_library():
    words = [bytes(random.Random(n).randrange(33, 256) for _ in range(n)) for n in range(100)]
    assert resampling.hashes(*spans_of(words)).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


@pytest.mark.parametrize("keys", [None, 1, 3])
def test_table_keeps_different_bytes_apart(keys):
    """Also where all spans have one hash, or three."""
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 2, 7, 8, 9, 33, 40]))) for _ in range(400)]
    words += [b"p" * 64 + b"q", b"p" * 65, b"p" * 64 + b"q"]
    text, starts, sizes = spans_of(words)
    same = None if keys is None else np.array([xxhash.xxh64_intdigest(w) % keys for w in words], np.uint64)
    table = resampling.intern(text, starts, sizes, 997, same)
    slot = {}
    for w, s in zip(words, table.slots.tolist()):
        assert slot.setdefault(w, s) == s
    assert len(set(slot.values())) == len(slot)
    counts = Counter(words)
    for w, s in slot.items():
        assert table.bucket[s] == zlib.crc32(w) % 997 and table.count[s] == counts[w]
