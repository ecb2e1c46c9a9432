"""Listings: pages with totals, look-ups that fill gaps, pairs, violations, retrieval figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def page_with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the `total_count` of all; the count is an aggregate of one row, so no window pulls all rows together."""
    total = rows.agg(F.count("*").alias("total_count"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def filled(rows: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with `fields` from source(key, fields) where they are null; values that are there win. Fields that rows lack are added."""
    found = source.select(key, *[F.col(c).alias(f"_from_{c}") for c in fields])
    both = rows.join(found, key, "left")
    now = {c: F.coalesce(c, f"_from_{c}") if c in rows.columns else F.col(f"_from_{c}") for c in fields}
    return both.withColumns(now).drop(*[f"_from_{c}" for c in fields])


def in_pairs(rows: DataFrame, columns: list[str], *values: list) -> DataFrame:
    """Rows whose columns equal one of the tuples that the lists, zipped, make; a request's lists are bounded by `most_pairs`."""
    most_pairs = 10_000
    if len({len(v) for v in values}) != 1 or len(values[0]) > most_pairs:
        raise ValueError(f"lists of one length, at most {most_pairs}")
    kinds = dict(rows.dtypes)
    asked = rows.sparkSession.createDataFrame(list(zip(*values)), ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return rows.join(F.broadcast(asked), columns, "left_semi")


def children_of(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, node, child): the direct children of each node of the same tree."""
    below = nodes.select(tree, F.col(parent).alias(node), F.col(node).alias("child"))
    return nodes.select(tree, node).join(below, [tree, node])


def nodes_of(nodes: DataFrame, trees: DataFrame, chosen: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of the nodes(toc_id, node_id, ...) of chosen trees(toc_id, ...), by tree and node."""
    rows = nodes.where(F.col("toc_id").isin(list(chosen))).join(trees.where(F.col("toc_id").isin(list(chosen))), "toc_id")
    return rows.orderBy("toc_id", "node_id").offset(offset).limit(limit)


def unknown_pairs(entries: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that name what isn't indexed there: the violations of a request."""
    return entries.join(indexed.select(*keys), keys, "left_anti")


def retrieval_figures(items: DataFrame, kb: str, body: str, included: Column) -> DataFrame:
    """(kb, retrieved, included, dropped, tokens): figures of what was retrieved from each knowledge base; tokens of included texts are estimated as a quarter of their characters."""
    size = F.coalesce(F.floor(F.length(body) / 4), F.lit(0).cast("long"))
    return items.groupBy(kb).agg(F.count("*").alias("retrieved"), F.count_if(included).alias("included"), F.count_if(~included).alias("dropped"), F.coalesce(F.sum(F.when(included, size)), F.lit(0)).cast("long").alias("tokens"))


def selected_nodes(chosen: DataFrame, nodes: DataFrame, node: str, k: int) -> DataFrame:
    """chosen(node, document_rank, rank), a selection from outside, to the k best known nodes with their positional score."""
    from fathom.operators.structure import positional_score

    rows = nodes.join(F.broadcast(chosen.select(node, "document_rank", "rank")), node)  # a model's answer, of bounded length
    return rows.withColumn("score", F.round(positional_score(F.col("document_rank"), F.col("rank")), 6)).orderBy(F.desc("score"), node).limit(k)


def reranked(result: DataFrame, item: str, k: int, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best rows by scorer(result) -> (item, new_score); rows that it leaves out come last. Without a scorer the old order is cut."""
    if scorer is None:
        return result.orderBy(F.desc("score"), item).limit(k)
    rows = result.join(scorer(result).select(item, "new_score"), item, "left")
    return rows.orderBy(F.desc_nulls_last("new_score"), F.desc("score"), item).limit(k)


def context_text(result: DataFrame, group: str, item: str, header: Column, body: str) -> DataFrame:
    """(group, best, context) of a bounded result list: a header line, then the texts by score, blank lines between them."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), item, F.col(body).alias("t"))))
    texts = F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n")
    return result.groupBy(group).agg(F.max("score").alias("best"), F.first(header).alias("_h"), texts.alias("_t")).select(group, "best", F.concat("_h", F.lit("\n\n"), "_t").alias("context"))


def truncated(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows with `truncated`: whether the limit was reached, which also holds where there are just as many rows."""
    page = rows.orderBy(*order).limit(limit)
    return page.crossJoin(F.broadcast(page.agg((F.count("*") == limit).alias("truncated"))))


def dependencies(indexed: DataFrame, bases: DataFrame, source: str, base: str, name: str) -> DataFrame:
    """(source, bases): the names of the knowledge bases that use a source, distinct and sorted; a source is used by few."""
    both = indexed.select(source, base).distinct().join(bases.select(base, name), base)
    return both.groupBy(source).agg(F.array_sort(F.collect_set(name)).alias("bases"))


def described(spark: SparkSession, database: str | None = None) -> list[dict]:
    """Tables of the catalog with their columns, sorted; Spark keeps no primary or foreign keys."""
    tables = sorted(spark.catalog.listTables(database), key=lambda x: x.name)
    return [{"table": x.name, "columns": [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(x.name, database)]} for x in tables]
