"""Running sums by key where one key may hold any share of the rows.

Keys of up to `long` rows are summed by a window. The rows of longer ones are sorted over all tasks by key and order and written in parts. Sums are associative: a
part's sums, a row a key and part, are added up over the parts before it, and that carry is put on top of the sums within each part. So no task
gets more than its part of a key, whatever the key holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import shared_folder

#: Rows up to which a key is one task's.
LONG = 1_000_000


def with_running(rows: DataFrame, key: str, order: list[str], long: int | None = None, tasks: int | None = None, **values: Column) -> DataFrame:
    """rows with a column for each of `values`: its sum over the rows of the key up to this one, in the order of the columns `order` (nulls first), as long or double.

    Nulls count as nothing. Rows with equal order are told apart by nothing but their place after sorting; name enough columns. Rows without a key are a key of their own.
    """
    most = LONG if long is None else long
    spark = rows.sparkSession
    prepared = rows.withColumns({n: F.coalesce(v, F.lit(0)) for n, v in values.items()})
    sizes = rows.groupBy(key).count()
    heavy = sizes.where(F.col("count") > most).select(F.col(key).alias("_key"))
    if heavy.isEmpty():
        return _window(prepared, [key], order, list(values))
    same = F.col(key).eqNullSafe(F.col("_key"))
    light = _window(prepared.join(heavy, same, "left_anti"), [key], order, list(values))
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(key), *[F.asc_nulls_first(c) for c in order]]
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    ordered = prepared.join(heavy, same, "left_semi").repartitionByRange(n, *by).sortWithinPartitions(*by)
    ordered.withColumn("_part", F.spark_partition_id()).write.parquet(path)  # parts must not change any more
    table = spark.read.schema(ordered.withColumn("_part", F.lit(0)).schema).parquet(path)
    parts = table.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(*[F.sum(c).alias(f"_sum_{c}") for c in values])
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a task
    carried = parts.select("_k", "_p", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_sum_{c}") for c in values])
    own = _window(table, [key, "_part"], order, list(values))
    met = own.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return light.unionByName(met.withColumns({c: F.col(c) + F.col(f"_sum_{c}") for c in values}).select(*light.columns))


def _window(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.sum(c).over(over) for c in values})
