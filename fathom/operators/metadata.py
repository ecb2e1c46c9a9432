"""The metadata table of a knowledge base, whose columns change: field lists come and go, and what was answered under one is read under the next.

A run of enrichment writes its rows under the fields of its time, in a folder of its own. Reading puts all runs under the fields of now: fields that a run lacks are null,
those that are gone are not shown, and those whose type or choices have changed are read as what the type makes of them. Of an item the last run counts, and none that is
older than its removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import json, params
from fathom.sources.commits import CommitLog

#: Columns that every row has besides its fields.
OWN = "item_id string, item_type string, enriched_at timestamp, _enrichment_error string"


def _typed(fields: list[dict]) -> str:
    return OWN + "".join(f", `{f['name']}` {params.FIELD_TYPES[f['type']].simpleString()}" for f in fields)


def _as_now(field: dict, old: list[dict]) -> Column:
    """A field of now from a run that was written under the fields `old`."""
    kind = params.FIELD_TYPES[field["type"]].simpleString()
    was = next((f for f in old if f["name"].lower() == field["name"].lower()), None)
    if was is None:
        return F.lit(None).cast(kind).alias(field["name"])
    value = F.col(f"`{was['name']}`")
    if was["type"] == field["type"] and was.get("enum_values") == field.get("enum_values"):
        return value.alias(field["name"])
    return json.coerced(value.cast("string"), field["type"], field.get("enum_values")).alias(field["name"])


class MetadataTable:
    """The table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def define(self, fields: list[dict]) -> int:
        """The fields from now on; ValueError for a list that isn't right. Rows stay. Gives the version."""
        if problems := params.check_fields(fields):
            raise ValueError("; ".join(problems))
        return self.log.commit(lambda old: {"seq": 0, "runs": [], "removals": []} | old | {"fields": fields})[0]

    def enrich(self, answers: DataFrame, full: bool = False) -> int:
        """Write answers(item_id, item_type, answer, error), answer being a JSON object; gives the version. full: what was there before goes.

        A value that doesn't fit its field's type is null; an answer that is no object has only nulls, and an error where it brought none. An item is in answers once.
        """
        _, held = self.log.state()
        if "fields" not in held:
            raise LookupError("no fields are defined")
        fields = held["fields"]
        body = F.coalesce("answer", F.lit("")).cast("string")
        is_object = F.coalesce(F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{"), F.lit(False))
        note = F.when(F.col("error").isNotNull(), F.col("error").cast("string")).when(~is_object, "no object")
        values = [F.when(is_object, json.coerced(json.field(body, f["name"]), f["type"], f.get("enum_values"))).alias(f["name"]) for f in fields]
        own = [F.col("item_id").cast("string").alias("item_id"), F.col("item_type").cast("string").alias("item_type"), F.current_timestamp().alias("enriched_at"), note.alias("_enrichment_error")]
        path = self.log.fresh("run")
        answers.select(*own, *values).write.parquet(path)

        def change(old: dict) -> dict:
            seq = old["seq"] + 1
            run = {"path": path, "fields": fields, "seq": seq}
            return old | {"seq": seq, "runs": [*([] if full else old["runs"]), run], "removals": [] if full else old["removals"]}

        return self.log.commit(change)[0]

    def remove(self, items: DataFrame) -> int:
        """Rows of items(item_id) are gone until a later run brings them again. Gives the version."""
        path = self.log.fresh("removal")
        items.select(F.col("item_id").cast("string").alias("item_id")).distinct().write.parquet(path)
        return self.log.commit(lambda old: old | {"seq": old["seq"] + 1, "removals": [*old["removals"], {"path": path, "seq": old["seq"] + 1}]})[0]

    def rows(self, version: int | None = None) -> DataFrame:
        """(item_id, item_type, enriched_at, _enrichment_error, fields): one row an item, under the fields of the version, the newest if none is named."""
        _, held = self.log.state(version)
        if "fields" not in held:
            raise LookupError("no fields are defined")
        fields = held["fields"]
        out = self.spark.createDataFrame([], f"{_typed(fields)}, _seq int")
        for run in held["runs"]:
            own = self.spark.read.schema(_typed(run["fields"])).parquet(run["path"])
            out = out.unionByName(own.select("item_id", "item_type", "enriched_at", "_enrichment_error", *[_as_now(f, run["fields"]) for f in fields], F.lit(run["seq"]).alias("_seq")))
        rest = [c for c in out.columns if c not in ("item_id", "_seq")]
        last = out.groupBy("item_id").agg(F.max("_seq").alias("_seq"), F.max_by(F.struct(*[f"`{c}`" for c in rest]), "_seq").alias("_row"))
        for gone in held["removals"]:
            dead = self.spark.read.schema("item_id string").parquet(gone["path"]).withColumn("_dead", F.lit(gone["seq"]))
            last = last.join(dead, "item_id", "left").where(F.col("_dead").isNull() | (F.col("_seq") > F.col("_dead"))).drop("_dead")
        return last.select("item_id", *[F.col("_row")[c].alias(c) for c in rest])

    def to_enrich(self, items: DataFrame, item: str, choice: str) -> DataFrame:
        """Of items all, the unenriched (no row), or the failed (a row with an error), by one join."""
        found = self.rows().select(F.col("item_id").alias("_id"), F.col("_enrichment_error").isNotNull().alias("_failed"))
        met = items.join(found, F.col(item).cast("string") == F.col("_id"), "left")
        kept = {"all": F.lit(True), "unenriched": F.col("_id").isNull(), "failed": F.coalesce("_failed", F.lit(False))}
        if choice not in kept:
            raise ValueError(f"unknown choice {choice!r}")
        return met.where(kept[choice]).drop("_id", "_failed")
