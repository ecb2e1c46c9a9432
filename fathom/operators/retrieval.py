"""Retrieval: vector and BM25 search, fusion, limits, floors, budgets.

Result lists are of bounded length (k rows); everything before the cut is one
pass over the items with a top-k per task. Query vectors and the statistics of a
query's terms enter as literals, never as joins.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import regex
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.functions import json, text, vectors


def vector_scores(rows: DataFrame, vector: Column, digits: int = 6) -> DataFrame:
    """rows(embedding, ...) with their cosine similarity `score`; zero, null and odd-sized vectors drop out."""
    return rows.withColumn("score", F.round(vectors.cosine(F.col("embedding"), vector), digits)).where("score is not null")


def filtered(rows: DataFrame, among: dict[str, list] | None = None, meta: dict | None = None, meta_column: str = "meta", dims: int | None = None, vector: str = "embedding") -> DataFrame:
    """Rows to search: columns within lists (knowledge bases, sources, items), JSON metadata that contains `meta`, vectors of `dims` numbers. All before anything is scored, so that a cut never comes up short."""
    for column, values in (among or {}).items():
        rows = rows.where(F.col(column).isin(list(values)))
    if meta:
        rows = rows.where(json.contains(F.col(meta_column), meta))
    return rows.where(F.size(vector) == dims) if dims is not None else rows


def items_with_vectors(items: DataFrame, embeddings: DataFrame, item: str, dims: int) -> DataFrame:
    """items joined with their vectors of `dims` numbers; an item with vectors of two models of one length comes twice."""
    if not 1 <= dims <= vectors.MOST_DIMS:
        raise ValueError(f"dims is 1 to {vectors.MOST_DIMS}")
    return items.join(embeddings.where(F.size("embedding") == dims), item)


def fetched(rows: DataFrame, item: str, result: DataFrame) -> DataFrame:
    """A result list (item, ...), of bounded length, with the columns of rows: its ids reach the scan as a filter."""
    found = result.collect()
    ids = [r[item] for r in found]
    held = rows.sparkSession.createDataFrame(found, result.schema)
    return rows.where(F.col(item).isin(ids)).join(F.broadcast(held), item)


def top(scored: DataFrame, item: str, k: int, threshold: float | None = None) -> DataFrame:
    """The k best rows by score; ties go to the lesser item."""
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), item).limit(k)


def per_source(scored: DataFrame, source: str, item: str, each: int, sources: int | None = 50, threshold: float | None = None) -> DataFrame:
    """The `each` best items of the `sources` best sources (of all, if None), with their place in the source; what is below the threshold goes before both.

    At most `sources` rows are broadcast; the window keeps `each` rows a source on the map side.
    """
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    best = scored.groupBy(source).agg(F.max("score").alias("best"))
    leading = best if sources is None else F.broadcast(best.orderBy(F.desc("best"), source).limit(sources))
    order = Window.partitionBy(source).orderBy(F.desc("score"), item)
    return scored.join(leading, source).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)


def bm25(docs: DataFrame, item: str, body: str, terms: list[str], k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """docs with `score` for the rows that hold at least one of the terms.

    idf = ln(max(1, (N - df + .5) / (df + .5))); length counts tokens. Null texts
    count as documents without tokens. The statistics are one aggregation over all
    documents, run at once: a row a term reaches the driver. The scores are a second scan.
    """
    nothing = docs.withColumn("score", F.lit(None).cast("double")).where("false")
    if not terms:
        return nothing
    words = F.coalesce(text.tokens(F.col(body)), F.array().cast("array<string>"))
    counted = docs.withColumn("_w", words).withColumns({"_n": F.size("_w"), "_hits": F.filter("_w", lambda w: w.isin(terms))})
    marked = counted.select("_n", F.explode(F.concat(F.array_distinct("_hits"), F.array(F.lit("")))).alias("term"))  # "" stands for the document
    stats = {r["term"]: r for r in marked.groupBy("term").agg(F.count("*").alias("df"), F.sum("_n").alias("total")).collect()}
    if "" not in stats or not stats[""]["total"]:
        return nothing
    n = stats[""]["df"]
    mean = stats[""]["total"] / n
    weights = [(t, math.log(max(1.0, (n - stats[t]["df"] + 0.5) / (stats[t]["df"] + 0.5)))) for t in terms if t in stats]
    if not weights:
        return nothing

    def part(w: Column) -> Column:
        tf = F.size(F.filter(F.col("_hits"), lambda x: x == w["term"]))
        return w["idf"] * tf / (tf + k1 * (1 - b + b * F.col("_n") / mean))

    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(idf).alias("idf")) for t, idf in weights])
    score = F.aggregate(table, F.lit(0.0), lambda total, w: total + part(w))
    return counted.where(F.size("_hits") > 0).select(*docs.columns, F.round(score, digits).alias("score"))


def query_terms(words: str) -> list[str]:
    """Distinct tokens of a query, in order, by the rule of text.tokens."""
    return list(dict.fromkeys(regex.findall(text.WORDS, words.lower())))


def ranked(result: DataFrame, item: str) -> DataFrame:
    """A result list (bounded) with `rank` from 1."""
    return result.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), item)).cast("long"))


def fused(left: DataFrame, right: DataFrame, item: str, weight: float = 0.5, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of two result lists; a list that lacks an item adds nothing."""
    a = ranked(left, item).select(item, F.col("rank").alias("_a"))
    c = ranked(right, item).select(item, F.col("rank").alias("_c"))
    term = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return a.join(c, item, "full").select(item, F.round(term(weight, "_a") + term(1 - weight, "_c"), 6).alias("score"))


def source_limits(pool: DataFrame, source: str, item: str, k: int, most: int | None = None, least: int = 0) -> DataFrame:
    """k rows of the pool: first each source's `least` best (best source first), then by score, at most `most` a source."""
    by = Window.partitionBy(source).orderBy(F.desc("score"), item)
    placed = pool.withColumn("_p", F.row_number().over(by)).withColumn("_best", F.max("score").over(Window.partitionBy(source)))
    if most:
        placed = placed.where(F.col("_p") <= max(most, least))
    kept = F.col("_p") <= least
    return placed.orderBy(F.desc(kept), F.desc_nulls_last(F.when(kept, F.col("_best"))), F.desc("score"), item).limit(k).drop("_p", "_best")


def with_floor(main: DataFrame, floor: DataFrame, item: str, rescore: bool = True) -> DataFrame:
    """Main results, then floor results that are not among them, tagged and, where the scores are of two kinds, scored below the least of main."""
    extra = ranked(floor.join(main.select(item), item, "left_anti"), item)
    least = main.agg(F.min("score").alias("m")).scalar()
    below = (extra.withColumn("score", F.round(F.coalesce(least, F.col("score")) - 0.01 * F.col("rank"), 6)) if rescore else extra).drop("rank")
    return main.withColumn("source_floor", F.lit(False)).unionByName(below.withColumn("source_floor", F.lit(True)))


def within_budget(result: DataFrame, item: str, group: str, body: str, limit: int | None, header: int = 0) -> DataFrame:
    """The leading rows whose running token estimate stays within the limit; groups by best score, a header charged once each.

    No limit or 0 keeps all. The first row that overflows ends the list.
    """
    grouped = by_document(result, item, group)
    first = F.row_number().over(Window.partitionBy("group_key").orderBy(F.desc("score"), item)) == 1
    cost = grouped.withColumn("tokens", F.coalesce(text.token_estimate(F.col(body)), F.lit(0)) + F.when(first, F.lit(header)).otherwise(0))
    order = Window.orderBy(F.desc("best"), "group_key", F.desc("score"), item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cost.withColumn("running", F.sum("tokens").over(order))
    return run.where(F.col("running") <= limit) if limit else run


def by_document(result: DataFrame, item: str, group: str) -> DataFrame:
    """`group_key` (items without a source stand alone) and the `best` score of the group."""
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("item:"), F.col(item).cast("string")))
    return result.withColumn("group_key", key).withColumn("best", F.max("score").over(Window.partitionBy("group_key")))


def fresh_pages(items: DataFrame, source: str, item: str, pages: str) -> DataFrame:
    """(item, fresh): whether an item is the first of its source, by id, to show any of its pages. Items without pages are fresh."""
    shown = items.select(source, item, F.explode(pages).alias("page"))
    firsts = shown.groupBy(source, "page").agg(F.min(item).alias(item)).select(item).distinct().withColumn("_f", F.lit(True))
    return items.join(firsts, item, "left").select(item, (F.coalesce("_f", F.lit(False)) | (F.size(pages) == 0)).alias("fresh"))


def merged(lists: list[DataFrame], item: str, k: int) -> DataFrame:
    """Result lists of several knowledge bases as one, by raw score."""
    return top(reduce(DataFrame.unionByName, lists), item, k)


def pipeline(main: DataFrame, item: str, source: str, k: int, method: str, threshold: float = 0.0, floor: DataFrame | None = None, enrichment: DataFrame | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None, least: int | None = None) -> DataFrame:
    """A fetched result list (item, source, score, meta) to the final k rows, with retrieval_method, source_floor, enrichment and pages.

    In this order: the method is noted; the threshold cuts vector search only, whose scores it is meant for; floor(item, source, score, meta), the best of each
    source, is merged, scored below main unless both are vector scores; enrichment(item, enrichment) is attached; scorer(rows) -> (item, new_score)
    reorders, and cuts only where no limits do; limits of `most` and `least` rows a source and k rows; pages from the metadata.
    """
    from fathom.operators.listings import reranked
    from fathom.operators.structure import item_pages

    rows = main
    if method == "vector_search" and threshold > 0:
        rows = rows.where(F.col("score") >= threshold)
    rows = with_floor(rows, floor, item, rescore=method != "vector_search") if floor is not None and least else rows.withColumn("source_floor", F.lit(False))
    rows = rows.withColumn("retrieval_method", F.lit(method))
    rows = rows.join(enrichment.select(item, "enrichment"), item, "left") if enrichment is not None else rows.withColumn("enrichment", F.lit(None).cast("string"))
    if scorer is not None:
        limited = bool(most or least)
        found = scorer(rows).select(item, "new_score")
        rows = rows.join(found, item, "left").withColumn("score", F.coalesce("new_score", F.lit(-1.0))).drop("new_score") if limited else reranked(rows, item, k, scorer).withColumn("score", F.coalesce("new_score", "score")).drop("new_score")
    return source_limits(rows, source, item, k, most, least or 0).withColumn("pages", item_pages(F.col("meta")))


def enrichment_of(labels: DataFrame, item: str, fields: list[str], status: str) -> DataFrame:
    """(item, enrichment): the fields that are not null as a JSON object, if the knowledge base's enrichment is completed, with or without errors; else nothing."""
    if status not in ("completed", "completed_with_errors"):
        return labels.select(item, F.lit(None).cast("string").alias("enrichment")).where("false")
    return labels.select(item, json.packed(**{f: F.col(f) for f in fields}).alias("enrichment")).where("enrichment is not null")


def assembled(result: DataFrame, item: str, source: str, body: str, pages: str, limit: int | None = None, grouped: bool = True) -> DataFrame:
    """A bounded result list as parts of a context: place, item, text, tokens, included, shown_before.

    grouped: sources by their best score, each with a header, else by score alone. A row whose pages were all shown before, by an included or earlier row of
    its source, says so instead of its text. The parts up to the first that overflows the limit of tokens (a quarter of the characters) are
    included; no limit or 0 includes all.
    """
    rows = by_document(result, item, source)
    order = [F.desc("best"), "group_key", F.desc("score"), item] if grouped else [F.desc("score"), item]
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a result list, of bounded length
    shown = rows.select(source, "place", F.explode(pages).alias("_page")).groupBy(source, "_page").agg(F.min("place").alias("place")).select("place").distinct().withColumn("_new", F.lit(True))
    rows = rows.join(F.broadcast(shown), "place", "left")
    overlaps = (F.size(pages) > 0) & F.col("_new").isNull()
    note = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]"))
    told = F.when(overlaps, F.concat(note, F.lit(" (content already shown above)"))).otherwise(F.concat(note, F.lit("\n"), F.coalesce(body, F.lit(""))))
    first = F.row_number().over(Window.partitionBy("group_key").orderBy("place")) == 1
    header = F.when(first & F.lit(grouped), F.concat(F.lit("## "), F.col("group_key"), F.lit("\n"))).otherwise("")
    rows = rows.select("place", item, F.concat(header, told).alias("text"), overlaps.alias("shown_before")).withColumn("tokens", text.token_estimate(F.col("text")))
    running = F.sum("tokens").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("included", running <= limit if limit else F.lit(True))


def assembly_figures(parts: DataFrame) -> DataFrame:
    """(total, included, dropped, overlapping, tokens) of assembled()."""
    there = F.col("included")
    return parts.agg(F.count("*").alias("total"), F.count_if(there).alias("included"), F.count_if(~there).alias("dropped"), F.count_if(there & F.col("shown_before")).alias("overlapping"), F.coalesce(F.sum(F.when(there, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"))


def fanned_out(builders: dict[str, Callable[[], DataFrame]], item: str, k: int, parallel: int = 8, seconds: float | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Result lists of several knowledge bases, merged by raw score, and what went wrong by base. It has failed (None) only if all went wrong.

    Lists are of bounded length and run side by side, `parallel` at a time, each in a pool of its own where the scheduler is fair. A base that takes
    longer than `seconds` counts as failed, and its jobs are cancelled; the others go on.
    """
    spark = SparkSession.active()
    sc, run = spark.sparkContext, uuid.uuid4().hex

    def asked(name: str, tag: str) -> tuple[list, StructType]:
        sc.setLocalProperty("spark.scheduler.pool", tag)
        sc.addJobTag(tag)
        rows = top(builders[name]().withColumn("knowledge_base", F.lit(name)), item, k)
        return rows.collect(), rows.schema

    lists, errors = [], {}
    tags = {name: f"{run}-{i}" for i, name in enumerate(builders)}
    workers = ThreadPoolExecutor(max_workers=max(1, min(parallel, len(builders) or 1)))
    try:
        started = {name: workers.submit(inheritable_thread_target(spark)(asked), name, tag) for name, tag in tags.items()}
        end = None if seconds is None else time.monotonic() + seconds
        for name, job in started.items():
            try:
                found, schema = job.result(None if end is None else max(0.0, end - time.monotonic()))
                lists.append(spark.createDataFrame(found, schema))
            except TimeoutError:
                job.cancel()
                sc.cancelJobsWithTag(tags[name])
                errors[name] = f"took more than {seconds} s"
            except Exception as e:  # one base must not take the others with it
                errors[name] = str(e).split("\n")[0][:160]
    finally:
        workers.shutdown(wait=False, cancel_futures=True)
    return (merged(lists, item, k) if lists else None), errors
