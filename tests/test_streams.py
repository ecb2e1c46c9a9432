"""Streams with state and ledgers, table functions, and several bases asked side by side."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from fathom.operators import retrieval, state
from fathom.plans import table_functions
from fathom.streaming import events

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, who string, ts timestamp"


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def arrive(spark, folder, rows):
    spark.createDataFrame([(i, w, DAY + dt.timedelta(seconds=s)) for i, w, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def limited(spark, tmp_path, delay):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = events.limited(events.ledger(spark, str(tmp_path / "in"), schema, 1), "who", "event_id", 2, 60, delay=delay)
    events.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(180)
    return {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_limiter_goes_on_after_a_restart_and_forgets_what_is_old(spark, tmp_path):
    first = [(1, "a", 0), (2, "a", 10), (3, "a", 20), (4, "b", 5), (5, None, 6)]
    arrive(spark, tmp_path / "in", first)
    assert limited(spark, tmp_path, "10 seconds") == {1: True, 2: True, 3: False, 4: True}
    arrive(spark, tmp_path / "in", [(6, "a", 65), (7, "a", 66), (8, "c", 1000)])  # a new run, from the checkpoint: one place is free at 60 s
    assert limited(spark, tmp_path, "10 seconds") == {1: True, 2: True, 3: False, 4: True, 6: True, 7: False, 8: True}
    arrive(spark, tmp_path / "in", [(9, "a", 3), (10, "a", 2000), (11, "a", 2001), (12, "a", 2002)])  # 9 is late: the watermark stands at 990 s
    found = limited(spark, tmp_path, "10 seconds")
    assert 9 not in found and [found[k] for k in (10, 11, 12)] == [True, True, False]
    batch = spark.read.parquet(str(tmp_path / "in")).where("event_id <> 9")
    assert sorted(found.items()) == sorted((r.event_id, r.accepted) for r in state.sliding_window(batch, "who", "ts", "event_id", 2, 60).collect())


def test_a_batch_that_comes_again_writes_nothing(spark, tmp_path):
    ticks = events.Ticks(spark, str(tmp_path / "t"))
    assert ticks.rows() is None
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, w string")
    assert ticks.write(rows, 0) and not ticks.write(rows, 0)
    assert ticks.write(rows.where("id = 2"), 1) and not ticks.write(rows, 0) and not ticks.write(rows, 1)
    assert told(ticks.rows()) == [(1, "x"), (2, "y"), (2, "y")]
    assert events.Ticks(spark, str(tmp_path / "t")).log.version() == 2
    rows.write.parquet(ticks.log.fresh("batch"))  # what a writer left that was cut off
    assert ticks.rows().count() == 3


@pytest.mark.parametrize("every", [None, "100 milliseconds"])
def test_ticks_of_a_stream(spark, tmp_path, every):
    ticks = events.Ticks(spark, str(tmp_path / "out"))
    for k in range(2):
        arrive(spark, tmp_path / "in", [(k, "a", k)])
        stream = ticks.start(events.ledger(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1), every)
        if every:
            stream.processAllAvailable()
            stream.stop()
        assert every or stream.awaitTermination(120)
    assert sorted(r.event_id for r in ticks.rows().collect()) == [0, 1]


@pytest.fixture
def functions(spark):
    spark.createDataFrame([(1, "Invoice_2024", "extracted"), (2, "invoiceX2024", "extracted"), (3, "50% off", "extracted"), (4, "invoice_2024", "pending"), (5, "a\\b", "extracted"), (6, None, "extracted")], "id long, name string, extraction_status string").createOrReplaceTempView("sources")
    spark.createDataFrame([(2, 7), (2, 7), (1, 8), (None, 7)], "source_id long, knowledge_base_id long").createOrReplaceTempView("indexed_sources")
    spark.createDataFrame([(DAY, "failed", 5), (DAY + dt.timedelta(minutes=61), "completed", None), (None, "failed", 1)], "created_at timestamp, status string, total_tokens long").createOrReplaceTempView("agent_runs")
    table_functions.register(spark)
    return spark


@pytest.mark.parametrize(
    "arguments, want",
    [
        ("7", [(1, 4), (3, 4), (5, 4), (6, 4)]),
        ("8, 'VOICE_2'", []),
        ("7, 'VOICE_2'", [(1, 1)]),
        ("7, '%'", [(3, 1)]),
        ("7, '\\\\'", [(5, 1)]),
        ("7, ''", [(1, 3), (3, 3), (5, 3)]),
        ("99, NULL, 2, 1", [(3, 5), (1, 5)]),
        ("7, NULL, -1, -5", []),
        ("7, NULL, 10, 50", []),
        ("p_kb_id => 7, p_limit => 1", [(6, 4)]),
    ],
)
def test_sources_that_a_base_lacks(functions, arguments, want):
    got = functions.sql(f"SELECT id, total_count FROM list_sources_excluding({arguments})")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_buckets_of_runs(functions):
    ask = lambda since, unit: told(functions.sql(f"SELECT bucket, total_runs, failed_runs, total_tokens FROM run_buckets(TIMESTAMP '{since}', '{unit}')"))
    assert [r[1:] for r in ask("2024-01-01", "day")] == [(2, 1, 5)]
    assert sorted(r[1:] for r in ask("2024-01-01", "hour")) == [(1, 0, 0), (1, 1, 5)]
    assert ask("2024-01-01", "week") == [] and ask("2030-01-01", "day") == []


def test_a_table_function_with_state(functions):
    rows = [(k, w, DAY + dt.timedelta(seconds=s)) for k, (w, s) in enumerate([("a", 0), ("a", 5), ("a", 9), ("a", 61), ("b", 1)])] + [(9, "b", None)]
    functions.createDataFrame(rows, SCHEMA).createOrReplaceTempView("asked")
    got = functions.sql("SELECT event_id, accepted FROM rate_limited(TABLE(asked) PARTITION BY who ORDER BY (ts), 'ts', 2, 60)")
    assert told(got) == [(0, True), (1, True), (2, False), (3, True), (4, True), (9, False)]
    for bad in ("TABLE(asked) PARTITION BY who ORDER BY (ts), 'when', 2, 60", "5, 'ts', 2, 60"):
        with pytest.raises(Exception, match="no column|first argument"):
            functions.sql(f"SELECT * FROM rate_limited({bad})").collect()


def test_a_base_that_takes_too_long_is_given_up(spark):
    good = lambda: spark.range(3).select(F.col("id").alias("item"), F.col("id").cast("double").alias("score"))

    def slow():
        waits = F.udf(lambda x: time.sleep(40) or float(x), "double")
        return spark.range(2).select(F.col("id").alias("item"), waits("id").alias("score"))

    began = time.monotonic()
    found, errors = retrieval.fanned_out({"slow": slow, "good": good, "none": lambda: 1 / 0}, "item", 2, seconds=12)
    assert time.monotonic() - began < 35
    assert told(found.select("item", "knowledge_base")) == [(1, "good"), (2, "good")]
    assert set(errors) == {"slow", "none"} and errors["slow"].startswith("took more than") and errors["none"] == "division by zero"
    assert retrieval.fanned_out({}, "item", 2) == (None, {})
