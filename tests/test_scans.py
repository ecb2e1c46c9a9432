"""Running sums in parts against plain loops: one key may hold all rows."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import scans, sessions, structure


def events(n=700, seed=2):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(n)]), k, rng.random() < 0.7, rng.choice([None, 1, 2, 5])) for k in range(n)]


@pytest.mark.parametrize("long", [None, 0, 100])
def test_running_sums(spark, long):
    rows = events()
    got = scans.with_running(spark.createDataFrame(rows, "k int, at int, id int, f boolean, v int"), "k", ["at", "id"], long, 7, v=F.col("v"), n=F.lit(1))
    want, held = set(), {}
    for k, at, i, f, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total, n = held.get(k, (0, 0))
        held[k] = total + (v or 0), n + 1
        want.add((k, at, i, f, *held[k]))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)


@pytest.mark.parametrize("long", [None, 50])
def test_streaks_of_one_key_with_nearly_all_rows(spark, long):
    rows = [r for r in events() if r[0]]
    got = sessions.streaks(spark.createDataFrame(rows, "k int, at int, id int, f boolean, v int"), "k", ["at", "id"], F.col("f"), 3, long)
    want = []
    for key in (1, 2):
        run = []
        for _, _, i, f, _ in [*sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), (0, 0, 0, False, 0)]:
            if f:
                run.append(i)
                continue
            if len(run) >= 3:
                want.append((key, run[0], run[-1], len(run)))
            run = []
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("long", [None, 10])
def test_pages_of_a_document_of_many_lines(spark, long):
    rng = random.Random(5)
    lines = ["x" * rng.randrange(0, 30) for _ in range(900)]
    text = "\n".join(lines)
    pages = spark.createDataFrame([(1, i + 1, len(x)) for i, x in enumerate(lines)] + [(2, 1, 3)], "doc int, page int, n_chars int")
    docs = spark.createDataFrame([(1, text), (2, "abc")], "doc int, text string")
    got = structure.pages_of_chunks(pages, structure.chunks(docs, "doc", "text", 100, 10), "doc", 64, long)
    want, at = {(2, 0, 1)}, 0
    starts = []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    for r in structure.chunks(docs, "doc", "text", 100, 10).where("doc = 1").collect():
        want |= {(1, r.chunk_index, i + 1) for i, s in enumerate(starts) if r.start < s + len(lines[i]) and r.start + len(r.text) > s}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k int, at int, v int")
    assert scans.with_running(none, "k", ["at"], 0, v=F.col("v")).collect() == []
