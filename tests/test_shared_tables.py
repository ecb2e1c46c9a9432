"""The vector index and the table of work."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import cells, claims

SCHEMA = "item long, embedding array<float>, kind string"


def vectors(n=1500, dims=12, groups=20, seed=3):
    """Vectors around some directions, and some that no search may find."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    rows = [(k, [float(x) for x in middle[k % groups] + 0.4 * rng.normal(size=dims)], "abc"[k % 3]) for k in range(n)]
    return rows + [(9001, None, "a"), (9002, [], "a"), (9003, [0.0] * dims, "a"), (9004, [float("nan")] * dims, "a"), (9005, [1.0, 2.0], "b"), (9006, None, "b")]


def brute(rows, query, k, keep=lambda r: True, least=-2.0):
    q = np.array(query)
    found = []
    for item, v, kind in rows:
        if v and len(v) == len(q) and np.isfinite(v).all() and any(v) and keep((item, v, kind)):
            x = np.array(v, np.float32).astype(float)
            found.append((round(float(x @ q / np.linalg.norm(x) / np.linalg.norm(q)), 6), item))
    return [(i, s) for s, i in sorted((f for f in found if f[0] >= least), key=lambda f: (-f[0], f[1]))[:k]]


def told(df):
    return [(r["item"], r["score"]) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    held = cells.VectorIndex(spark, str(tmp_path_factory.mktemp("v")))
    held.build(spark.createDataFrame(vectors(), SCHEMA))
    return held


@pytest.mark.parametrize("k, keep", [(10, None), (40, "a"), (5, "none"), (2000, None)])
def test_exact_search_equals_brute_force(index, k, keep):
    for query in ([float(x) for x in np.random.default_rng(5).normal(size=12)], vectors()[7][1]):
        got = index.search(query, k, where=None if keep is None else F.col("kind") == keep)
        want = brute(vectors(), query, k, (lambda r: True) if keep is None else (lambda r: r[2] == keep))
        assert np.allclose([s for _, s in told(got)], [s for _, s in want], atol=2e-6) and {i for i, _ in told(got)} == {i for i, _ in want}


def test_few_cells_find_nearly_all(index):
    """Recall over a set of queries; more cells are read only while the filter leaves too few rows."""
    hits = total = 0
    for item in range(0, 1500, 150):
        query = vectors()[item][1]
        want = {i for i, _ in brute(vectors(), query, 10)}
        hits += len(want & {i for i, _ in told(index.search(query, 10, probes=6))})
        total += 10
    assert hits / total >= 0.95
    rare = index.search(vectors()[0][1], 3, probes=1, where=F.col("item").isin(11, 12, 13))
    assert {i for i, _ in told(rare)} == {11, 12, 13}


def test_a_far_cell_is_not_read(spark, tmp_path):
    """Exact, and yet not all cells: folders of those that can't matter are not listed in any scan."""
    held = cells.VectorIndex(spark, str(tmp_path))
    tight = [(k, [float(x) for x in np.eye(16)[k % 16] + 0.001 * np.random.default_rng(k).normal(size=16)], "x") for k in range(640)]
    held.build(spark.createDataFrame(tight, SCHEMA), 16)
    read = []
    best = held._best
    held._best = lambda part, some, *rest: read.extend(some) or best(part, some, *rest)
    assert [i for i, _ in told(held.search(tight[3][1], 5))] == [i for i, _ in brute(tight, tight[3][1], 5)]
    assert len(read) == cells.FIRST < 16


def test_rows_added_later(spark, tmp_path):
    held = cells.VectorIndex(spark, str(tmp_path))
    rows = vectors(300)
    held.build(spark.createDataFrame(rows[:200], SCHEMA))
    held.add(spark.createDataFrame(rows[200:304], SCHEMA))
    assert held.add(spark.createDataFrame(rows[300:304], SCHEMA)) == held.log.version()
    assert [i for i, _ in told(held.search(rows[250][1], 8))] == [i for i, _ in brute(rows, rows[250][1], 8)]
    best = [i for i, _ in brute(rows, rows[250][1], 8)]
    held.remove(spark.createDataFrame([(best[0],), (best[2],), (77777,)], "item long"))
    left = [r for r in rows if r[0] not in (best[0], best[2])]
    assert [i for i, _ in told(held.search(rows[250][1], 8))] == [i for i, _ in brute(left, rows[250][1], 8)]
    held.add(spark.createDataFrame([r for r in rows if r[0] == best[0]], SCHEMA))
    assert [i for i, _ in told(held.search(rows[250][1], 8))] == [i for i, _ in brute([*left, *[r for r in rows if r[0] == best[0]]], rows[250][1], 8)]
    with pytest.raises(ValueError, match="no centroids"):
        held.add(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "x")], SCHEMA))


def test_an_index_of_nothing(spark, tmp_path):
    held = cells.VectorIndex(spark, str(tmp_path))
    assert told(held.search([1.0], 3)) == []
    held.build(spark.createDataFrame([(1, None, "x")], SCHEMA))
    assert told(held.search([1.0], 3)) == [] and told(held.search([0.0, 0.0], 3)) == []


WORK = "id long, status string, owner string, attempts int, note string"


def table(spark, folder, n=60):
    held = claims.WorkTable(spark, str(folder), "id", 4)
    rows = [(k, "pending" if k % 2 else "indexed", None if k % 2 else "old", 0, f"n{k}") for k in range(n)] + [(None, "pending", None, 0, "nameless"), (n, None, None, 0, "?")]
    held.create(spark.createDataFrame(rows, WORK))
    return held


def test_of_two_claimers_one_gets_a_row(spark, tmp_path):
    table(spark, tmp_path)
    got, failed = {}, []

    def work(name):
        try:
            mine = claims.WorkTable(spark, str(tmp_path), "id", 4)
            got[name] = [r["id"] for r in mine.claim(name).collect()]
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert sorted(got["a"] + got["b"], key=str) == sorted([*range(1, 60, 2), None], key=str), "each row once"
    held = {r["id"]: (r.status, r.owner, r.attempts) for r in claims.WorkTable(spark, str(tmp_path), "id", 4).rows().collect()}
    assert all(held[k] == ("indexing", n, 1) for n in "ab" for k in got[n]) and held[0] == ("indexed", "old", 0) and held[60] == (None, None, 0)


def test_claims_of_other_rows_both_stand(spark, tmp_path):
    """A change to other buckets goes on top of the version that came between, without being made again."""
    held = table(spark, tmp_path)
    other = claims.WorkTable(spark, str(tmp_path), "id", 4)
    by = {}
    for r in held._bucketed(held.rows()).where("status = 'pending' and id is not null").collect():
        by.setdefault(r["_bucket"], r["id"])
    a, b = list(by.values())[:2]
    times = []

    def slow(rows):
        times.append(1)
        if len(times) == 1:
            assert [r["id"] for r in other.claim("b", F.col("id") == b).collect()] == [b]
        return claims.state.claimed(rows, "a")

    version, _ = held.update((F.col("status") == "pending") & (F.col("id") == a), slow)
    assert version == 3 and len(times) == 1
    assert {r["id"]: r.owner for r in held.rows().where("status = 'indexing'").collect()} == {a: "a", b: "b"}


def test_only_the_owner_finishes(spark, tmp_path):
    held = table(spark, tmp_path)
    held.claim("a", F.col("id") < 10)
    assert held.finish("b", "indexed") == 0 and held.finish("a", "indexed", F.col("id") < 4) == 2
    alive = spark.createDataFrame([("b",)], "owner string")
    assert held.recover(alive) == 3
    assert held.finish("a", "indexed") == 0, "taken from it"
    assert sorted(r["id"] for r in held.claim("b", F.col("id") < 10).collect()) == [5, 7, 9]
    assert {r.attempts for r in held.rows().where("owner = 'b'").collect()} == {2}
    assert not held.create(held.rows())
    with pytest.raises(LookupError):
        claims.WorkTable(spark, str(tmp_path / "none"), "id").rows()
