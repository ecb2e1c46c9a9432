"""Runs, listings and sinks on small rows with nulls, repeats and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import listings, runs
from fathom.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_chat_messages_prefer_the_content(spark):
    say = lambda *pairs: json.dumps([{"role": r, "content": c} for r, c in pairs])
    data = [
        (1, say(("system", "s"), ("user", "a"), ("user", None)), say(("tool", "t"), ("assistant", "old")), "new [1]", "completed"),
        (2, say(("user", "b")), say(("assistant", "out"), ("assistant", "later")), "", "failed"),
        (3, "no json", None, None, "completed"),
        (4, None, "[]", "only", None),
    ]
    df = spark.createDataFrame(data, "run int, input_messages string, output_messages string, content string, status string")
    assert rows(runs.chat_messages(df, ["run"])) == [(1, 0, "user", "a"), (1, 1, "user", ""), (1, 2, "assistant", "new [1]"), (2, 0, "user", "b"), (2, 1, "assistant", "out"), (4, 0, "assistant", "only")]
    assert rows(runs.model_history(df, ["run"])) == [(1, 0, "user", "a"), (1, 1, "user", ""), (1, 2, "assistant", "new")]
    assert runs.chat_messages(df.where("false"), ["run"]).count() == 0


def test_hydrated_keeps_runs_without_children(spark):
    df = spark.createDataFrame([(1,), (2,)], "run int")
    calls = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "x")], "run int, order int, value string")
    assert rows(runs.hydrated(df, "run", calls=calls, cited=calls.where("false"))) == [(1, ["a", "b"], []), (2, [], [])]


def test_overview_and_outputs(spark):
    df = spark.createDataFrame([("s", 1, ""), ("s", 2, None), ("s", 3, "hi"), ("e", 1, None)], "s string, at int, said string")
    assert rows(runs.overview(df, "s", "at", "said")) == [("e", 1, None, 1), ("s", 3, "hi", 3)]
    blocks = spark.createDataFrame([(1, 1, "response", "r"), (1, 2, "agent", "late"), (2, 1, "agent", "x"), (2, 2, "response", None), (3, 1, "agent", None)], "run int, n int, type string, output string")
    assert rows(runs.final_output(blocks, "run", "n")) == [(1, "r", "late"), (2, None, "x"), (3, None, None)]


def test_reasoning_is_null_without_text(spark):
    kind = "id int, events array<struct<type:string,content:string>>"
    df = spark.createDataFrame([(1, [("reasoning", "a"), ("tool", "b"), ("reasoning", ""), ("reasoning", "c")]), (2, [("reasoning", None)]), (3, None), (4, [])], kind)
    assert rows(df.select("id", runs.reasoning_summary(F.col("events")))) == [(1, "a\n\nc"), (2, None), (3, None), (4, None)]


def test_items_by_reference_or_text(spark):
    asked = spark.createDataFrame([(0, 7, None), (1, None, "inline"), (2, 8, None), (3, None, None), (4, 7, "ignored")], "position int, item int, text string")
    got = runs.resolved_items(asked, spark.createDataFrame([(7, "seven"), (9, "nine")], "item int, text string"))
    assert rows(got) == [(0, 7, "seven"), (1, None, "inline"), (4, 7, "seven")]


def test_patches_and_replacements(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, x string, y int")
    assert rows(runs.patched(old, spark.createDataFrame([(1, None, 5), (3, "z", 9)], "k int, x string, y int"), "k")) == [(1, "a", 5), (2, "b", None)]
    assert rows(runs.replaced(old, spark.createDataFrame([(1, "n", 0), (1, "m", 0)], old.schema), "k")) == [(1, "m", 0), (1, "n", 0), (2, "b", None)]
    held = spark.createDataFrame([(1, "enriching", "me", "stale"), (2, "enriching", "you", "stale"), (3, "done", "me", None), (4, "enriching", None, None), (5, "enriching", "me", None)], "id int, status string, owner string, prior string")
    assert rows(runs.restored(held, "me").select("id", "status", "owner")) == [(1, "stale", None), (2, "enriching", "you"), (3, "done", "me"), (4, "enriching", None), (5, "indexed", None)]


def test_pages_carry_the_total(spark):
    df = spark.range(7)
    assert [tuple(r) for r in listings.page_with_total(df, ["id"], 2, 3).collect()] == [(3, 7), (4, 7)]
    assert listings.page_with_total(df, ["id"], 2, 9).count() == 0
    assert listings.page_with_total(df.where("false"), ["id"], 2).count() == 0


def test_filled_does_not_overwrite(spark):
    df = spark.createDataFrame([(1, "own"), (1, None), (2, None), (None, None)], "k int, title string")
    source = spark.createDataFrame([(1, "found", "d")], "k int, title string, doc string")
    assert rows(listings.filled(df, source, "k", ["title", "doc"])) == sorted([(1, "own", "d"), (1, "found", "d"), (2, None, None), (None, None, None)], key=repr)


def test_pairs_go_together(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "x int, y string")
    assert rows(listings.in_pairs(df, ["x", "y"], [1, 2], ["a", "b"])) == [(1, "a")]
    assert listings.in_pairs(df, ["x", "y"], [], []).count() == 0
    with pytest.raises(ValueError):
        listings.in_pairs(df, ["x", "y"], [1], [])


def test_rerank_falls_back_to_the_old_order(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.5)], "item int, score double")
    assert [r[0] for r in listings.reranked(df, "item", 2).collect()] == [2, 3]
    scorer = lambda d: d.where("item <> 2").select("item", (-F.col("item")).alias("new_score"))
    assert [r[0] for r in listings.reranked(df, "item", 3, scorer).collect()] == [1, 3, 2]


def test_writes_need_their_guards(spark):
    table = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    assert rows(sinks.written(table, "insert", [{"id": 3, "name": "c"}], generated=("id",))) == rows(spark.createDataFrame([(1, "a"), (2, None), (None, "c")], table.schema))
    assert rows(sinks.written(table, "update", {"name": "z"}, {"name": None})) == [(1, "a"), (2, "z")]
    assert rows(sinks.written(table, "delete", where={"id": 1})) == [(2, None)]
    for bad in [("drop",), ("insert",), ("insert", [{}]), ("insert", [{"id": 1}, {"name": "x"}]), ("update", {"name": "z"}), ("update", None, {"id": 1}), ("delete",), ("delete", None, {"nope": 1}), ("delete", None, {"id = 1 OR 1": 1})]:
        with pytest.raises(ValueError):
            sinks.written(table, *bad)


def test_stores_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 10, 0, "a", [1.0, 2.0]), (2, 10, 1, "b", None)], "item_id int, source_id int, chunk_index int, text string, embedding array<double>")
    items, vectors = sinks.chunk_rows(chunks, "kb1", "m")
    sinks.store(items, str(tmp_path / "items"), by=["knowledge_base_id"])
    sinks.store(items.withColumn("knowledge_base_id", F.lit("kb2")), str(tmp_path / "items"), by=["knowledge_base_id"])
    sinks.store(items.limit(1), str(tmp_path / "items"), "overwrite", ["knowledge_base_id"])
    kept = spark.read.parquet(str(tmp_path / "items"))
    assert rows(kept.groupBy("knowledge_base_id").count()) == [("kb1", 1), ("kb2", 2)]
    assert rows(vectors) == [(1, "kb1", "m", 2, [1.0, 2.0])]
    slim, texts = sinks.document_rows(chunks, "kb1", "root/")
    assert rows(slim)[0] == (1, "kb1", 10, 1, "root/10/1.txt") and rows(texts) == [(1, "a"), (2, "b")]


def test_inserts_of_what_is_absent(spark):
    old = spark.createDataFrame([(1, 1, "old")], "run int, key int, excerpt string")
    new = spark.createDataFrame([(1, 1, "again", 0), (1, 2, "second", 5), (1, 2, "first", 2)], "run int, key int, excerpt string, at int")
    assert rows(sinks.inserted_absent(old, new, ["run", "key"], "at")) == [(1, 2, "first", 2)]


def test_catalog_is_described(spark):
    spark.range(1).selectExpr("id", "'x' AS name").createOrReplaceTempView("described_here")
    found = {x["table"]: [c["name"] for c in x["columns"]] for x in listings.described(spark)}
    assert found["described_here"] == ["id", "name"]
    spark.catalog.dropTempView("described_here")
