"""Runs of agents and workflows: messages, children, outputs, sets of rows that are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import scans

MESSAGES = "array<struct<role:string,content:string>>"
POINTER = "\n\n[... full text in storage]"  # fixed value: what a cut text ends in


def chat_messages(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs(*keys, input_messages, output_messages, content) to (*keys, position, role, content).

    User messages come from the input array; then one assistant message: the content, or where that
    is empty the first assistant message of the output array. Arrays that aren't JSON hold nothing.
    """
    asked = F.filter(F.coalesce(F.from_json("input_messages", MESSAGES), F.array().cast(MESSAGES)), lambda m: m["role"] == "user")
    told = F.filter(F.from_json("output_messages", MESSAGES), lambda m: m["role"] == "assistant")
    answer = F.coalesce(F.nullif("content", F.lit("")), F.get(told, F.lit(0))["content"])
    said = F.when(answer.isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))).otherwise(F.array().cast(MESSAGES))
    rows = runs.select(*keys, F.posexplode(F.concat(asked, said)).alias("position", "_m"))
    return rows.select(*keys, "position", "_m.role", F.coalesce("_m.content", F.lit("")).alias("content"))


def model_history(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The messages of completed runs, without citation markers."""
    return chat_messages(runs.where(F.col("status") == "completed"), keys).withColumn("content", text.without_citations(F.col("content")))


def hydrated(runs: DataFrame, run: str, **parts: DataFrame) -> DataFrame:
    """runs with one array a part; a part is (run, order, value), its values are listed in order. Runs without any have an empty array.

    Each part is grouped by run before the join; a run holds few children.
    """
    for name, part in parts.items():
        listed = F.transform(F.array_sort(F.collect_list(F.struct("order", "value"))), lambda x: x["value"])
        runs = runs.join(part.groupBy(run).agg(listed.alias(name)), run, "left")
        kind = dict(runs.dtypes)[name]
        runs = runs.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return runs


def placed(parents: DataFrame, key: str, children: DataFrame, order: list[str], long: int | None = None) -> DataFrame:
    """parents with their children(key, order, ...), a row a child with its `place` from 1; a parent without any has one row of nulls.

    The same as a list a parent, for parents of any number of children: those of more than `long` are numbered in parts.
    """
    numbered = scans.with_running(children, key, order, long, place=F.lit(1)).withColumn("place", F.col("place").cast("long"))
    return parents.join(numbered, key, "left")


def overview(runs: DataFrame, session: str, at: str, said: str) -> DataFrame:
    """(session, run_count, first_message, last_activity): the first message that isn't empty."""
    full = F.when(F.coalesce(F.col(said), F.lit("")) != "", F.col(at))
    return runs.groupBy(session).agg(F.count("*").alias("run_count"), F.min_by(said, full).alias("first_message"), F.max(at).alias("last_activity"))


def reasoning_summary(events: Column) -> Column:
    """The contents of reasoning events of an array of (type, content), a blank line between them; null if there are none."""
    told = F.filter(events, lambda e: (e["type"] == "reasoning") & (F.coalesce(e["content"], F.lit("")) != ""))
    return F.when(F.size(told) > 0, F.array_join(F.transform(told, lambda e: e["content"]), "\n\n"))


def final_output(blocks: DataFrame, run: str, order: str) -> DataFrame:
    """blocks(run, order, type, output) to (run, final, last_output): the response block's output; the last output of any block."""
    there = F.col("output").isNotNull()
    answers = F.when(there & (F.col("type") == "response"), F.col(order))
    return blocks.groupBy(run).agg(F.max_by("output", answers).alias("final"), F.max_by("output", F.when(there, F.col(order))).alias("last_output"))


def staggered(at: Column, place: Column) -> Column:
    """Times of messages that were stored at once, one microsecond apart, so that their order lasts."""
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), place.cast("decimal(18,6)") / F.lit(1_000_000).cast("decimal(7,0)"))


def light_text(kind: Column, path: Column, body: Column, most: int = 500) -> Column:
    """A stored full document's text, cut with a pointer; other texts stay."""
    stored = (kind == "full_document") & (F.coalesce(path, F.lit("")) != "") & (F.length(body) > most)
    return F.when(stored, F.concat(F.left(body, F.lit(most)), F.lit(POINTER))).otherwise(body)


def resolved_items(asked: DataFrame, contents: DataFrame) -> DataFrame:
    """asked(position, item, text) to (position, item, text): an item is looked up in contents(item, text), a text stands for itself; the rest is dropped."""
    known = contents.select("item", "text")
    named = asked.where("item is not null").select("position", "item").join(known, "item").select("position", "item", "text")
    return named.unionByName(asked.where("item is null and text is not null").select("position", "item", "text"))


def patched(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` with the fields that `new` gives; nulls of `new` leave a field as it is, keys that `old` lacks are ignored."""
    given = [c for c in new.columns if c != key]
    both = old.join(new.select(key, *[F.col(c).alias(f"_new_{c}") for c in given]), key, "left")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The children of parents that occur in `new` are replaced as a set."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def restored(rows: DataFrame, owner: str) -> DataFrame:
    """One fenced write: rows still enriching under this owner get back the status they had."""
    mine = (F.col("status") == "enriching") & (F.col("owner") == owner)
    return rows.withColumns({"status": F.when(mine, F.coalesce("prior", F.lit("indexed"))).otherwise(F.col("status")), "owner": F.when(~F.coalesce(mine, F.lit(False)), F.col("owner"))})


def latency_ms(began: Column, ended: Column) -> Column:
    """Whole milliseconds between two times; null while a run lasts."""
    return F.timestamp_diff("MILLISECOND", began, ended)
