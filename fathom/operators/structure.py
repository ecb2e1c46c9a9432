"""Chunks, windows, page maps, trees and reference graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import scans


def chunks(docs: DataFrame, item: str, body: str, size: int = 2000, overlap: int = 50) -> DataFrame:
    """(item, chunk_index, start, text): pieces of `size` characters, each `overlap` into the one before; empty texts have none."""
    step, n = size - overlap, F.length(body)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    rows = docs.where(n > 0).select(item, body, F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_index", "_c"))
    return rows.select(item, "chunk_index", (F.col("_c") * step).alias("start"), F.substring(F.col(body), F.col("_c") * step + 1, F.lit(size)).alias("text"))


def pages_of_chunks(pages: DataFrame, cut: DataFrame, item: str, width: int = 2000, long: int | None = None) -> DataFrame:
    """(item, chunk_index, page) where the half-open spans meet; pages(item, page, n_chars) are joined by one separator each.

    A range join in bins of `width` characters: a chunk meets the pages of the bins it touches, not all pages of its document; a pair that
    meets in several bins counts in the first of them. Where a page begins is a running sum, in parts for items of more than `long` pages.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(b - 1, a) / width))).alias("_bin")
    sized = pages.select(item, F.col("page").cast("int").alias("page"), F.col("n_chars").cast("long").alias("_n"))
    summed = scans.with_running(sized, item, ["page", "_n"], long, _to=F.col("_n") + 1)
    placed = summed.select(item, "page", (F.col("_to") - 1 - F.col("_n")).alias("_from"), (F.col("_to") - 1).alias("_to"))
    placed = placed.select("*", bins(F.col("_from"), F.col("_to")))
    spans = cut.select(item, "chunk_index", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text")).cast("long").alias("_end"))
    spans = spans.select("*", bins(F.col("start"), F.col("_end")))
    first = F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("_from") / width))
    met = spans.join(placed, [item, "_bin"]).where((F.col("start") < F.col("_to")) & (F.col("_end") > F.col("_from")) & first)
    return met.select(item, "chunk_index", "page")


def header_chunks(docs: DataFrame, item: str, body: str, size: int = 2000, overlap: int = 50) -> DataFrame:
    """(item, section, heading, chunk_index, text): a text is split before its markdown headings, but for lines of fenced code, and each section cut as by chunks(). Blank sections are left out; what stands before the first heading has none."""
    mark = "\ufdd0"  # no character of any text
    pieces = F.split(F.col(body), r"(?m)(?=^ {0,3}```)", -1)  # a piece starts with each fence: text and code take turns
    starts = F.when(F.col(body).rlike(r"^ {0,3}```"), 0).otherwise(1)
    hidden = F.transform(pieces, lambda s, i: F.when((i >= starts) & ((i - starts) % 2 == 0), F.regexp_replace(s, r"(?m)^(?=#)", mark)).otherwise(s))
    cut = F.split(F.array_join(hidden, ""), r"(?m)(?=^#{1,6}[ \t])", -1)
    sections = docs.where(F.length(body) > 0).select(item, F.posexplode(cut).alias("section", "_s")).where(F.col("_s").rlike(r"\S"))
    sections = sections.withColumn("_s", F.replace("_s", F.lit(mark), F.lit("")))
    heading = F.nullif(F.trim(F.regexp_extract("_s", r"^#{1,6}[ \t]+([^\n]*)", 1)), F.lit(""))
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("_s") - overlap) / step).cast("int") - 1)
    rows = sections.select(item, "section", heading.alias("heading"), "_s", F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_index", "_c"))
    return rows.select(item, "section", "heading", "chunk_index", F.substring(F.col("_s"), F.col("_c") * step + 1, F.lit(size)).alias("text"))


def item_pages(meta: Column) -> Column:
    """Pages that an item covers, sorted, by its JSON metadata: `pages` as far as they are whole numbers, else start_page to end_page, else start_page, else none."""
    whole = lambda v: F.trim(v).try_cast("int")
    listed = F.filter(F.transform(F.from_json(F.get_json_object(meta, "$.pages"), "array<string>"), whole), lambda x: x.isNotNull())
    start, end = (whole(F.get_json_object(meta, f"$.{k}_page")) for k in ("start", "end"))
    span = F.when(end >= start, F.sequence(start, end)).when(end < start, F.array().cast("array<int>")).otherwise(F.array(start))
    return F.array_sort(F.array_distinct(F.when(F.size(listed) > 0, listed).when(start.isNotNull(), span).otherwise(F.array().cast("array<int>"))))


def item_images(pages: Column, images: Column, most: int = 10) -> Column:
    """Of images(page, path), an array in order of page, those on the pages; all if there are no pages; at most so many."""
    return F.slice(F.when(F.size(pages) > 0, F.filter(images, lambda x: F.array_contains(pages, x["page"]))).otherwise(F.array_sort(images)), 1, most)


def positional_score(document_rank: Column, rank: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.02 * document_rank - 0.05 * rank)


def positional_scores(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(item, group, score): rows of a group in order of item, the group being the document's rank. A score is 0 from the twentieth row on, so only twenty rows
    of a group are put in order."""
    order = Window.partitionBy(group).orderBy(item)
    leading = rows.select(group, item).withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < 20)
    ranked = rows.select(group, item).join(leading.select(item, "_rank"), item, "left")
    return ranked.select(item, group, F.coalesce(positional_score(F.col(group), F.col("_rank")), F.lit(0.0)).alias("score"))


def valid_references(nodes: DataFrame) -> DataFrame:
    """nodes(node_id, parent_id, refs) to (node_id, ref): known nodes other than the node, its parent and its children."""
    asked = nodes.select("node_id", "parent_id", F.explode(F.array_distinct("refs")).alias("ref"))
    known = nodes.select(F.col("node_id").alias("ref"), F.col("parent_id").alias("_up"))
    own = (F.col("ref") == F.col("node_id")) | F.col("ref").eqNullSafe(F.col("parent_id")) | F.col("_up").eqNullSafe(F.col("node_id"))
    return asked.join(known, "ref").where(~own).select("node_id", "ref")


def expanded(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, score, kind): seeds, nodes they refer to (least score - .01), those nodes' children (.01 less again); the first kind wins."""
    least = seeds.agg(F.min("score").alias("m")).scalar()
    floor = lambda by: F.round(F.greatest(F.lit(0.0), least - by), 6)
    picked = F.broadcast(seeds.select("node_id"))  # a result list, of bounded length
    refs = nodes.join(picked, "node_id", "left_semi").select(F.explode("refs").alias("node_id")).distinct()
    near = nodes.select("node_id").join(refs, "node_id", "left_semi").join(picked, "node_id", "left_anti")
    below = nodes.join(near.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id")
    below = below.join(picked, "node_id", "left_anti").join(near, "node_id", "left_anti")
    out = seeds.select("node_id", "score", F.lit("seed").alias("kind"))
    return out.unionByName(near.select("node_id", floor(0.01).alias("score"), F.lit("reference").alias("kind"))).unionByName(below.select("node_id", floor(0.02).alias("score"), F.lit("child").alias("kind")))


def rendered(nodes: DataFrame, tree: str) -> DataFrame:
    """nodes(tree, node_id, depth, title) to one indented text per tree, in order of node_id."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("title"))
    lines = F.array_sort(F.collect_list(F.struct("node_id", line.alias("line"))))
    return nodes.groupBy(tree).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("toc"))
