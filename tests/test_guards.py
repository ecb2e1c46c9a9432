import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathom.functions import params
from fathom.operators import records, retrieval, sparse


@pytest.mark.parametrize("sql", ["select 1", "WITH a AS (SELECT 1) SELECT * FROM a;", "CREATE OR REPLACE VIEW v AS SELECT 1", "CREATE UNIQUE INDEX CONCURRENTLY i ON t(c)", "CREATE TEMP TABLE x (id int)", "DROP TABLE IF EXISTS t", "SELECT 'see ai.agents; $$' AS x", "/* note */ DELETE FROM t WHERE a = 1"])
def test_statements_that_may_run(sql):
    assert params.sql_problem(sql) is None


@pytest.mark.parametrize("sql", ["", " \n", "-- only", "/* only */", "SET search_path TO ai", "SET /* x */ a TO b", "-- x\nGRANT ALL ON t TO u", "TRUNCATE t", "CREATE ROLE admin", "DROP SCHEMA public CASCADE", "SELECT 1; SELECT 2", "SELECT $$x$$", "SELECT $t$x$t$", "SELECT * FROM /* public. */ ai.agents", 'SELECT * FROM "auth".users', "SELECT * FROM pg_catalog . pg_class"])
def test_statements_that_may_not(sql):
    assert params.sql_problem(sql)


def test_read_only_tool(spark):
    assert params.run_read_only(spark, "select 1 as a") == '{"a":1}'
    assert len(params.run_read_only(spark, "select id from range(1000)", 50)) == 50
    for sql in ("delete from t", "select 1; select 2"):
        with pytest.raises(ValueError):
            params.run_read_only(spark, sql)


def test_identifiers_and_fields():
    assert params.identifier("a_1") == "a_1"
    for bad in ("1a", "a-b", "a" * 51, "", None):
        with pytest.raises(ValueError):
            params.identifier(bad)
    fine = [{"name": "kind", "type": "enum", "description": "d", "enum_values": ["a", "b"]}, {"name": "n", "type": "number", "description": "d"}]
    assert params.check_fields(fine) == [] and len(params.field_schema(fine)) == 6
    assert params.check_fields([*fine, {**fine[1], "name": "N"}]) == ["field 2: name is taken"]
    assert params.check_fields([{**fine[0], "enum_values": ["a"]}])


def test_limits_and_strategies():
    for config, wanted in [(None, (None, None)), ({}, (None, None)), ({"min_per_source": "1", "max_per_source": 3}, (1, 3)), ({"min_per_source": -1, "max_per_source": "bad"}, (None, None))]:
        assert params.source_limits(config) == wanted
    assert params.retriever("page_index") == "tree_search"
    with pytest.raises(ValueError):
        params.retriever("page_index", "hybrid")
    assert [params.fetch_count(10), params.fetch_count(10, 50), params.fetch_count(100, None, True)] == [10, 50, 200]


def test_cron():
    at = dt.datetime(2024, 2, 28, 23, 59)
    assert params.cron_next("*/15 * * * *", at) == dt.datetime(2024, 2, 29)
    assert params.cron_next("0 9 * * 1-5", dt.datetime(2024, 3, 1, 9)) == dt.datetime(2024, 3, 4, 9)
    assert params.cron_next("0 0 31 2 *", at) is None
    with pytest.raises(ValueError):
        params.cron_fields("61 * * * *")


def test_search_syntax(spark):
    words = spark.createDataFrame([(1, "red fox runs"), (2, "red dog"), (3, "fox red")], "id long, t string").select("id", F.split("t", " ").alias("w"))
    found = lambda q: [r[0] for r in words.where(params.search_condition(q, F.col("w"))).orderBy("id").collect()]
    assert [found("red fox"), found('"red fox"'), found("red -fox"), found("dog or runs"), found("")] == [[1, 3], [1], [2], [1, 2], []]


def test_sparse_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "dog", "a"), (3, None, "b"), (4, "the red fence", "b")], "id long, t string, kb string")
    path = str(tmp_path / "index")
    assert sparse.load(spark, path) is None
    index = sparse.store(sparse.postings(docs, "id", "t", "kb"), path)
    found = lambda df: [tuple(r) for r in df.collect()]
    want = found(retrieval.top(retrieval.bm25(docs, "id", "t", ["fox", "dog"]).select("id", "score"), "id", 9))
    assert found(sparse.search(index, ["fox", "dog"], 9)) == want
    assert sorted(map(tuple, index.totals.select("kb", "item_count", "tokens").collect())) == [("a", 2, 3), ("b", 2, 3)]
    assert [r[0] for r in found(sparse.search(index, ["red"], 9, spark.createDataFrame([(4,), (2,)], "item long")))] == [4]
    each = {r["item"]: r["kb"] for r in sparse.scores(index, ["red"], by_kb=True).collect()}
    assert each == {1: "a", 4: "b"}
    gone = sparse.without(index, spark.createDataFrame([(1,)], "item long"))
    assert found(sparse.search(gone, ["fox"], 9)) == []
    more = sparse.extended(gone, spark.createDataFrame([(2, "fox"), (5, "a b c d")], "id long, t string"), "id", "t")
    assert [r[0] for r in found(sparse.search(more, ["fox", "dog"], 9))] == [2]
    assert sparse.search(sparse.index_of(index.postings.where("false")), ["fox"], 9).count() == 0
    indexed, scan = sparse.IndexRetriever(spark, path), sparse.ScanRetriever(docs, "id", "t")
    assert [indexed.status(n) for n in (0, 3, 4)] == [None, "stale", "ready"]
    assert found(sparse.retriever(indexed, scan, 4).search(["fox", "dog"], 9)) == found(sparse.retriever(indexed, scan, 5).search(["fox", "dog"], 9)) == want


def test_records(spark):
    calls = spark.createDataFrame([(1, '[{"name":"a","ms":3},{"result":"ERROR x"}]'), (2, None), (3, "{bad"), (4, "[]")], "id long, c string")
    assert [tuple(r) for r in records.tool_calls(calls, "id", "c").where("name is not null and id < 3").collect()] == [(1, 0, "a", "success", 3), (1, 1, "unknown", "error", 0)]
    items = spark.createDataFrame([(1, [2, 1]), (1, [2]), (2, []), (2, [5]), (3, None)], "s long, p array<int>")
    assert sorted(map(tuple, records.needed_pages(items, "s", "p").collect())) == [(1, False, [1, 2]), (2, True, [5]), (3, True, [])]
