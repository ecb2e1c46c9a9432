"""A sparse index: postings on disk with a sidecar of totals; build, add, remove, search, and the scan it falls back to.

A folder holds `postings` (a folder for each bucket of terms) and, written last, `totals`: one row a knowledge base with its items, tokens and time of
building. A folder without totals is no index. A search reads the buckets of its terms and the totals, never the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import stem, text
from fathom.session import ship

#: Buckets of terms on disk.
BUCKETS = 64
#: Bytes of text whose postings are one part of each bucket: about a million postings a task.
PART_BYTES = 1 << 29
#: Words that a task counts at once, unless one text has more.
WORDS_AT_ONCE = 500_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The bucket of a term, told without a job."""
    h = xxhash.xxh64(term.encode(), seed=42).intdigest()
    return (h - 2**64 if h >= 2**63 else h) % BUCKETS


@dataclass(frozen=True)
class Index:
    """postings(bucket, kb, term, item, tf, n), n being the item's tokens; an item has a row with the empty term. totals(kb, item_count, tokens, built_at)."""

    postings: DataFrame
    totals: DataFrame


def _counted(stemmer: str | None):
    """Rows (kb, item, w) to one (kb, item, n, term, tf) for each term of a row's words w, and one with the empty term. A stem is told once a batch."""

    def rows(part: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch:
        coded = part.column("w").flatten().dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy()
        if stemmer:
            stems = pa.array(map(stem.STEMMERS[stemmer], terms.to_pylist()), pa.string()).dictionary_encode()
            terms, codes = stems.dictionary, stems.indices.to_numpy()[codes]
        width, every = len(terms) + 1, np.arange(len(lengths))
        keys, tf = np.unique(np.repeat(every, lengths) * width + codes + 1, return_counts=True)
        row, code = np.divmod(np.concatenate([keys, every * width]), width)  # term 0 is the empty one
        term = pa.concat_arrays([pa.array([""], pa.string()), terms.cast(pa.string())]).take(pa.array(code))
        kb, item = (part.column(c).take(pa.array(row)) for c in ("kb", "item"))
        counts = np.concatenate([tf, np.ones(len(every), np.int64)])
        return pa.RecordBatch.from_arrays([kb, item, pa.array(lengths[row], pa.int64()), term, pa.array(counts, pa.int64())], names=["kb", "item", "n", "term", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(lengths), 0
            while start < len(lengths):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + WORDS_AT_ONCE, "right")))
                yield rows(batch.slice(start, stop - start), lengths[start:stop])
                start = stop

    return run


def postings(docs: DataFrame, item: str, body: str | Column, kb: str | None = None, stemmer: str | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """One row for a term of an item of docs, and one with the empty term for each item. Null texts have no tokens.

    With stop_words terms are words of two characters or more that are none of them; with a stemmer they are stems. Terms are counted where their text is
    read, so that neither words nor postings are shuffled for it; only if an item has several rows do their postings meet.
    """
    body = F.col(body) if isinstance(body, str) else body
    base = F.col(kb).cast("string") if kb else F.lit("")
    found = text.tokens(body) if stop_words is None else text.search_tokens(body, stop_words, None)
    words = docs.select(base.alias("kb"), F.col(item).alias("item"), F.coalesce(found, F.array().cast("array<string>")).alias("w"))
    ship(docs.sparkSession)
    of_item = words.schema["item"].dataType.simpleString()
    counted = words.mapInArrow(_counted(stemmer), f"kb string, item {of_item}, n long, term string, tf long")
    if not docs.groupBy(F.col(item)).count().where("count > 1").isEmpty():
        counted = counted.groupBy("kb", "item", "term", "n").agg(F.sum("tf").alias("tf"))
    return counted.select(_bucket(F.col("term")).alias("bucket"), "kb", "term", "item", "tf", "n")


def parts_of(docs: DataFrame, body: str | Column) -> int:
    """In how many parts the buckets of docs are written, so that a task's share stays the same whatever the size of docs."""
    body = F.col(body) if isinstance(body, str) else body
    return max(1, math.ceil((docs.agg(F.sum(F.octet_length(body))).first()[0] or 0) / PART_BYTES))


def query_terms(words: str, stemmer: str | None = None, stop_words: list[str] | None = None) -> list[str]:
    """Distinct terms of a query, in order, as postings has them."""
    found = regex.findall(text.WORDS, words.lower())
    if stop_words is not None:
        found = [w for w in found if len(w) > 1 and w not in stop_words]
    return list(dict.fromkeys(stem.STEMMERS[stemmer](w) for w in found) if stemmer else dict.fromkeys(found))


def totals(rows: DataFrame, built_at: Column | None = None) -> DataFrame:
    """(kb, item_count, tokens, built_at) of postings."""
    marks = rows.where((F.col("bucket") == bucket_of("")) & (F.col("term") == ""))
    return marks.groupBy("kb").agg(F.count("*").alias("item_count"), F.sum("n").alias("tokens")).withColumn("built_at", built_at if built_at is not None else F.current_timestamp())


def index_of(rows: DataFrame) -> Index:
    """An index over postings that are not stored."""
    return Index(rows, totals(rows))


def write_postings(rows: DataFrame, path: str, parts: int = 1) -> None:
    """Terms of one bucket lie together and sorted, so that row-group statistics narrow a search.

    A bucket is written in so many parts, dealt by item, so that a frequent term is no one task and a task sorts no more than memory holds.
    """
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")
    dealt = rows.repartitionById(BUCKETS * parts, F.col("bucket") * parts + part)
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def store(rows: DataFrame, path: str, built_at: Column | None = None, parts: int = 1) -> Index:
    """Write postings, then the totals that make them an index."""
    write_postings(rows, f"{path}/postings", parts)
    spark = rows.sparkSession
    totals(spark.read.parquet(f"{path}/postings"), built_at).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index | None:
    """The index of a folder; None if there is none, or it isn't ready."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))


def without(index: Index, items: DataFrame) -> Index:
    """The index without these items(item)."""
    rows = index.postings
    return index_of(rows.join(items.select("item"), "item", "left_anti").select(*rows.columns))


def extended(index: Index, docs: DataFrame, item: str, body: str, kb: str | None = None) -> Index:
    """The index with these documents, which replace earlier ones of the same id."""
    kept = without(index, docs.select(F.col(item).alias("item"))).postings
    return index_of(kept.unionByName(postings(docs, item, body, kb)))


def scores(index: Index, terms: list[str], by_kb: bool = False, among: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(kb, item, score) by BM25 of the items that hold a term, with statistics of all items, or by_kb of each knowledge base.

    among(item): only these items, by a filter before any cut; the statistics stay those of all.
    """
    none = index.postings.select("kb", "item", F.lit(0.0).alias("score")).where("false")
    if not terms:
        return none
    hits = index.postings.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms))
    over = ["kb"] if by_kb else []
    df = hits.groupBy(*over, "term").agg(F.count("*").alias("df"))  # a row a term
    size = index.totals.groupBy(*over).agg(F.sum("item_count").alias("items"), (F.sum("tokens") / F.sum("item_count")).alias("mean"))
    if over:
        df = df.join(size, over)
    else:
        whole = size.first()
        if not whole["items"] or not whole["mean"]:
            return none
        df = df.withColumns({"items": F.lit(whole["items"]), "mean": F.lit(whole["mean"])})
    weights = df.select(*over, "term", "mean", F.log(F.greatest(F.lit(1.0), (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    if among is not None:
        hits = hits.join(among.select("item"), "item", "left_semi")
    part = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return hits.join(F.broadcast(weights) if not over else weights, [*over, "term"]).groupBy("kb", "item").agg(F.round(F.sum(part), 6).alias("score"))


def search(index: Index, terms: list[str], k: int, among: DataFrame | None = None) -> DataFrame:
    """(item, score): the k best items, ties to the lesser item."""
    return scores(index, terms, among=among).select("item", "score").orderBy(F.desc("score"), "item").limit(k)


class SparseRetriever(Protocol):
    """What a sparse retriever does for a knowledge base."""

    def status(self, current: int) -> str | None: ...

    def search(self, terms: list[str], k: int, among: DataFrame | None = None) -> DataFrame: ...


class IndexRetriever:
    """Searches the index of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.index = load(spark, path)

    def status(self, current: int) -> str | None:
        """absent, stale (another number of items), ready; None if there is nothing to index."""
        if not current:
            return None
        if self.index is None:
            return "absent"
        return "ready" if (self.index.totals.agg(F.sum("item_count")).first()[0] or 0) == current else "stale"

    def search(self, terms: list[str], k: int, among: DataFrame | None = None) -> DataFrame:
        if self.index is None:
            raise LookupError("no index")
        return search(self.index, terms, k, among)


class ScanRetriever:
    """Scores the texts themselves: what a search falls back to."""

    def __init__(self, docs: DataFrame, item: str, body: str):
        self.docs, self.item, self.body = docs, item, body

    def status(self, current: int) -> str | None:
        return "ready" if current else None

    def search(self, terms: list[str], k: int, among: DataFrame | None = None) -> DataFrame:
        from fathom.operators.retrieval import bm25

        found = bm25(self.docs, self.item, self.body, terms).select(F.col(self.item).alias("item"), "score")
        if among is not None:
            found = found.join(among.select("item"), "item", "left_semi")
        return found.orderBy(F.desc("score"), "item").limit(k)


def retriever(indexed: IndexRetriever, scan: ScanRetriever, current: int) -> SparseRetriever:
    """The index if it is ready, else the scan."""
    return indexed if indexed.status(current) == "ready" else scan
