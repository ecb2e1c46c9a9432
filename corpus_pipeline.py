"""A corpus pipeline over `documents`: toxicity, line dedup, n-gram Jaccard join, packing.

Every stage works on all rows that the one before kept. All but the last return
the columns of documents; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import line_dedup, ngram_join, packing, toxicity
from fathom.llm.common import settle
from fathom.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.3 or more go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one of them only; documents stay, perhaps shorter."""
    return line_dedup.dedup_lines(docs)


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more on five-word shingles connect, the least doc_id stays."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", keep_one_of_a_group), ("packing", pack)]

#: No SQL: the toxicity stage is a trained model and the packing stage a heuristic; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
