"""Conversations: trailing history, alternation, pairs, first messages, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import scans


def trailing_history(messages: DataFrame, session: str, turn: str, most: int) -> DataFrame:
    """The newest `most` messages of a session, from its first user message among them on."""
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    kept = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")
    start = F.min(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(session))
    return kept.withColumn("_s", start).where(F.col(turn) >= F.col("_s")).drop("_s")


def numbered(messages: DataFrame, session: str, turn: str) -> DataFrame:
    """Messages of users and assistants with their `position` from 0 in the session."""
    spoken = messages.where(F.col("role").isin("user", "assistant"))
    return spoken.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(turn)).cast("long") - 1)


def misplaced(messages: DataFrame, session: str, turn: str) -> DataFrame:
    """Messages that break the strict turn of user and assistant, or are blank."""
    wanted = F.when(F.col("position") % 2 == 0, "user").otherwise("assistant")
    return numbered(messages, session, turn).where((F.col("role") != wanted) | (F.coalesce(F.trim("text"), F.lit("")) == ""))


def pairs(messages: DataFrame, session: str, turn: str) -> DataFrame:
    """(session, pair, question, answer): neighbouring messages, two by two."""
    rows = numbered(messages, session, turn).withColumn("pair", F.floor(F.col("position") / 2))
    at = lambda k: F.max(F.when(F.col("position") % 2 == k, F.col("text")))
    return rows.groupBy(session, "pair").agg(at(0).alias("question"), at(1).alias("answer"))


def first_messages(messages: DataFrame, session: str, turn: str, most: int = 100) -> DataFrame:
    """(session, first_message, n_messages), partly summed before the shuffle."""
    return messages.groupBy(session).agg(F.left(F.min_by("text", turn), F.lit(most)).alias("first_message"), F.count("*").alias("n_messages"))


def streaks(rows: DataFrame, key: str, order: list[str], failed, least: int, long: int | None = None) -> DataFrame:
    """(key, first, last, length) of runs of `least` or more failed rows in a row, by the last column of `order`.

    A run is told by the number of other rows before it, and summed up where its rows are; keys of more than `long` rows are counted in parts.
    """
    seen = scans.with_running(rows.select(key, *order, failed.alias("_f")), key, order, long, _ok=F.when(F.col("_f"), 0).otherwise(1))
    point = F.struct(*order)
    runs = seen.where("_f").groupBy(key, "_ok").agg(F.min(point)[order[-1]].alias("first"), F.max(point)[order[-1]].alias("last"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("_ok")


def query_context(messages: DataFrame, session: str, turn: str, query: Column, weight: float, most: int = 6, chars: int = 500) -> DataFrame:
    """(session, context): the query max(1, int(weight)) times, then the last messages, cut to `chars`, in order."""
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    last = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    said = F.transform(F.array_sort(F.collect_list(F.struct(turn, F.left("text", F.lit(chars)).alias("said")))), lambda m: m["said"])
    return last.groupBy(session).agg(F.concat_ws(" ", F.array_repeat(query, max(1, int(weight))), said).alias("context"))


def seed_problems(messages: DataFrame, session: str, position: str, most: int = 200, chars: int = 20_000) -> DataFrame:
    """(session, position, problem): the first problem of each session to import that has one. position counts from 0, roles take turns from the user on.

    A problem of the whole (too many messages, an odd number) comes at position -1, before those of messages.
    """
    count = messages.groupBy(session).agg(F.count("*").alias("_n"))
    whole = F.when(F.col("_n") > most, "too many").when(F.col("_n") % 2 != 0, "odd")
    wanted = F.when(F.col(position) % 2 == 0, "user").otherwise("assistant")
    each = F.when(~F.col("role").eqNullSafe(wanted), "role").when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").when(F.length("text") > chars, "too long")
    found = messages.select(session, F.col(position).cast("long").alias("position"), each.alias("problem")).unionByName(count.select(session, F.lit(-1).cast("long").alias("position"), whole.alias("problem")))
    first = found.where("problem is not null").groupBy(session).agg(F.min(F.struct("position", "problem")).alias("_f"))
    return first.select(session, "_f.position", "_f.problem")
