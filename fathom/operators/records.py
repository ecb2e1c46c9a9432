"""Nested records: tool calls, block inputs, child rollups, settings, schedules, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import json

CALL = "array<struct<name:string,result:string,ms:int>>"


def tool_calls(rows: DataFrame, key: str, calls: str) -> DataFrame:
    """(key, position, name, status, ms) of the objects of a JSON array; a result that starts with error has failed. Other values have no calls."""
    told = rows.select(key, F.posexplode(F.from_json(calls, CALL)).alias("position", "_c"))
    failed = F.coalesce(F.lower("_c.result").startswith("error"), F.lit(False))
    return told.select(key, "position", F.coalesce("_c.name", F.lit("unknown")).alias("name"), F.when(failed, "error").otherwise("success").alias("status"), F.coalesce("_c.ms", F.lit(0)).alias("ms"))


def call_summary(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("ms").alias("total_ms"))


def children(rows: DataFrame, parent: str, order: str, value: str, out: str) -> DataFrame:
    """(parent, out): the children's values in order, joined by commas; a parent holds few children."""
    listed = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(parent).agg(F.array_join(F.transform(listed, lambda x: x[value].cast("string")), ",").alias(out))


def dangling(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges (source, target) with an end that is no block(id)."""
    ids = blocks.select("id").distinct()
    known = lambda end: ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    both = edges.join(known("source"), "source", "left").join(known("target"), "target", "left")
    return both.where(F.col("_source").isNull() | F.col("_target").isNull()).select("source", "target")


def overlay(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """defaults(key, kind, default, low, high, choices) with `value` as text: stored(key, text) where it is an int, float or bool in range or one of the choices, else the default.

    kind is int, float, bool or str; low, high and choices may be null. A bool is true for true, 1 and yes, and else false.
    """
    both = defaults.join(stored.select("key", F.col("text").alias("_t")), "key", "left")
    number = F.when(F.col("kind") == "int", F.trim("_t").try_cast("long").cast("double")).when(F.col("kind") == "float", F.trim("_t").try_cast("double"))
    fits = number.isNotNull() & F.coalesce(number >= F.col("low"), F.lit(True)) & F.coalesce(number <= F.col("high"), F.lit(True))
    chosen = F.coalesce(F.array_contains("choices", F.col("_t")), F.lit(True))
    given = F.when(F.col("kind").isin("int", "float") & fits & chosen, F.trim("_t")).when(F.col("kind") == "bool", F.lower("_t").isin("true", "1", "yes").cast("string")).when((F.col("kind") == "str") & chosen, F.col("_t"))
    return both.select("key", F.coalesce(given, F.col("default")).alias("value"))


def block_logs(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """blocks(id, type, name) and results(id, output) as JSON to (id, type, name, status, output): error if the output has an `error`, success with an output, else pending. Unknown blocks are named by their id."""
    both = results.withColumnRenamed("output", "_o").join(blocks, "id", "full")
    failed = json.has_any(F.col("_o"), ["error"])
    return both.select("id", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("name", F.col("id").cast("string")).alias("name"), F.when(failed, "error").when(F.col("_o").isNotNull(), "success").otherwise("pending").alias("status"), F.col("_o").alias("output"))


def unknown_types(blocks: DataFrame, known: list[str]) -> DataFrame:
    """blocks(id, type) of a type that isn't known."""
    return blocks.where(~F.coalesce(F.col("type").isin(known), F.lit(False)))


def due(last: Column, hours: Column, now: Column, runs: Column | None = None, most: int | None = None) -> Column:
    """Whether an interval schedule fires: never run, or the interval has passed, and runs are left."""
    passed = last.isNull() | (last + F.make_dt_interval(F.lit(0), hours) <= now)
    return passed & (runs < most) if runs is not None and most is not None else passed


def drift(then: Column, now: Column, enrichment: list[str]) -> Column:
    """none, enrichment_only (only these keys differ) or full."""
    return F.when(~json.differs(then, now), "none").when(~json.differs(then, now, enrichment), "enrichment_only").otherwise("full")


def needed_pages(items: DataFrame, source: str, pages: str) -> DataFrame:
    """(source, all_pages, pages): an item without pages asks for all of its source; pages are distinct and sorted."""
    shown = items.select(source, F.explode_outer(F.when(F.size(pages) > 0, F.col(pages))).alias("page"))
    return shown.groupBy(source).agg(F.bool_or(F.col("page").isNull()).alias("all_pages"), F.array_sort(F.collect_set("page")).alias("pages"))


def request_violations(entries: DataFrame, request: str, position: str, most: int = 10) -> DataFrame:
    """(request, position, problem): the first problem of each request that has one, of entries(request, position, id, top_k, similarity_threshold).

    Too many entries count for the whole request, at position -1; then, by position, no id, an id that stood earlier, top_k not 1 to 100, a threshold not
    0 to 1. Nulls of the last two are left to their defaults. All counts are reduced before the shuffle; an entry meets its id's first place by a join.
    """
    firsts = entries.where(F.col("id").isNotNull()).groupBy(request, "id").agg(F.min(position).alias("_first"))
    sizes = entries.groupBy(request).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    met = entries.join(firsts, [request, "id"], "left")
    problem = F.when(F.col("id").isNull(), "no id").when(F.col(position) > F.col("_first"), "id twice").when(~F.col("top_k").between(1, 100), "top_k").when(~F.col("similarity_threshold").between(0, 1), "threshold")
    each = met.select(request, F.col(position).cast("long").alias("position"), problem.alias("problem")).where("problem is not null")
    whole = sizes.select(request, F.lit(-1).cast("long").alias("position"), F.lit("too many").alias("problem"))
    first = each.unionByName(whole).groupBy(request).agg(F.min(F.struct("position", "problem")).alias("_p"))
    return first.select(request, "_p.position", "_p.problem")
