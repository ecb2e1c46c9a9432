"""Functions of SQL that give tables: relational ones as SQL functions, which Catalyst puts in place of the call, and one with state as a Python table function."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fathom.session import ship

#: Units of run_buckets; another gives no rows.
UNITS = ("minute", "hour", "day")


def _excluding(sources: str, indexed: str) -> str:
    """Extracted sources that a knowledge base has not indexed, whose names hold p_search literally, case aside, in order of name and id, with their number.

    The page comes from a top-k a task; the total is an aggregate of its own, so no row passes through one task for it.
    """
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION list_sources_excluding(p_kb_id BIGINT, p_search STRING DEFAULT NULL, p_limit INT DEFAULT 50, p_offset INT DEFAULT 0)
RETURNS TABLE (id BIGINT, name STRING, total_count BIGINT)
RETURN
  WITH eligible AS (
    SELECT s.id, s.name FROM {sources} s LEFT ANTI JOIN {indexed} i ON i.source_id = s.id AND i.knowledge_base_id = p_kb_id
    WHERE s.extraction_status = 'extracted' AND (p_search IS NULL OR contains(lower(s.name), lower(p_search))))
  SELECT id, name, (SELECT count(*) FROM eligible) AS total_count
  FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS place FROM eligible)
  WHERE place > greatest(p_offset, 0) AND place <= greatest(p_offset, 0) + greatest(p_limit, 0)"""


def _buckets(runs: str) -> str:
    """Runs since a time by minute, hour or day."""
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION run_buckets(since TIMESTAMP, bucket_trunc STRING)
RETURNS TABLE (bucket TIMESTAMP, total_runs BIGINT, failed_runs BIGINT, total_tokens BIGINT, last_activity_at TIMESTAMP)
RETURN
  SELECT date_trunc(bucket_trunc, r.created_at), count(*), count_if(r.status = 'failed'), coalesce(sum(r.total_tokens), 0), max(r.created_at)
  FROM {runs} r WHERE r.created_at >= since AND bucket_trunc IN ({', '.join(repr(u) for u in UNITS)})
  GROUP BY date_trunc(bucket_trunc, r.created_at)"""


class RateLimited:
    """rate_limited(TABLE(rows) PARTITION BY key ORDER BY time, 'time', most, seconds): the rows with `accepted`, true for a row if fewer than
    `most` accepted ones of its partition lie in the `seconds` before it. A partition's state is the times of the accepted rows that matter, `most` at the
    utmost; rows stream by. Rows without a time are not accepted and don't count."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, at: AnalyzeArgument, most: AnalyzeArgument, seconds: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        if at.value not in rows.dataType.fieldNames():
            raise ValueError(f"no column {at.value}")
        if "accepted" in (n.lower() for n in rows.dataType.fieldNames()):
            raise ValueError("there is a column called accepted")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("accepted", BooleanType()))

    def __init__(self):
        self.held: deque = deque()

    def eval(self, row: Row, at: str, most: int, seconds: int) -> Iterator[tuple]:
        t = row[at]
        while self.held and t is not None and (t - self.held[0]).total_seconds() >= seconds:
            self.held.popleft()
        accepted = t is not None and len(self.held) < most
        if accepted:
            self.held.append(t)
        yield (*row, accepted)


def register(spark: SparkSession, sources: str = "sources", indexed: str = "indexed_sources", runs: str = "agent_runs") -> None:
    """Make the functions callable from spark.sql, over tables or views of these names:

    sources(id, name, extraction_status), indexed_sources(source_id, knowledge_base_id), agent_runs(created_at, status, total_tokens).
    """
    ship(spark)
    spark.sql(_excluding(sources, indexed))
    spark.sql(_buckets(runs))
    spark.udtf.register("rate_limited", udtf(RateLimited))
