"""Sinks: stores of items as Parquet, ledgers, guarded writes to user tables.

A write is a pure step (old rows and new rows to new rows) and `store`, which
appends or overwrites. A version of a table is a folder; the caller moves the pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.params import identifier


def store(rows: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    """Write rows, a folder for each value of `by` (knowledge base, table), so that one base is rewritten or read alone."""
    out = rows.write.mode(mode)
    if by:
        out = out.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def chunk_rows(chunks: DataFrame, kb: str, model: str) -> tuple[DataFrame, DataFrame]:
    """chunks(item_id, source_id, chunk_index, text, embedding) as rows of the two stores: items and vectors. Chunks without a vector have no vector row."""
    items = chunks.select("item_id", F.lit(kb).alias("knowledge_base_id"), "source_id", "chunk_index", "text")
    vectors = chunks.where(F.col("embedding").isNotNull()).select("item_id", F.lit(kb).alias("knowledge_base_id"), F.lit(model).alias("model"), F.size("embedding").alias("dims"), "embedding")
    return items, vectors


def tree_rows(nodes: DataFrame, kb: str) -> tuple[DataFrame, DataFrame]:
    """nodes(source_id, node_id, parent_id, depth, title, text) as one row a tree, with its number of nodes, and the nodes."""
    trees = nodes.groupBy("source_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))
    return trees.withColumn("knowledge_base_id", F.lit(kb)), nodes.withColumn("knowledge_base_id", F.lit(kb))


def document_rows(docs: DataFrame, kb: str, root: str) -> tuple[DataFrame, DataFrame]:
    """docs(item_id, source_id, text) as a slim row with the path of the text, and the texts apart (item_id, text). Each document has a path of its own, in its source's folder."""
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("source_id").cast("string"), F.lit("/"), F.col("item_id").cast("string"), F.lit(".txt"))
    slim = docs.select("item_id", F.lit(kb).alias("knowledge_base_id"), "source_id", F.length("text").alias("n_chars"), path.alias("full_text_path"))
    return slim, docs.select("item_id", "text")


def json_rows(docs: DataFrame, kb: str, window: int = 4000, overlap: int = 200) -> DataFrame:
    """docs(item_id, source_id, document) of valid JSON as rows of the store of extracted documents, with an estimate of tokens and the number of windows that were read."""
    n = F.length("document")
    windows = F.greatest(F.lit(1), F.ceil((n - overlap) / (window - overlap))).cast("long")
    valid = docs.where(F.try_parse_json(F.col("document")).isNotNull())
    return valid.select("item_id", F.lit(kb).alias("knowledge_base_id"), "source_id", "document", F.floor(n / 4).cast("long").alias("token_count"), windows.alias("window_count"))


def upserted_vectors(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("item_id", "model")) -> DataFrame:
    """New vectors replace those of the same item and model; of new ones of one key the greatest row counts."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_m")).select(*[c if c in keys else F.col("_m")[c].alias(c) for c in new.columns])
    return old.join(one.select(*keys), list(keys), "left_anti").unionByName(one)


def inserted_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of `new` to append: keys that `old` lacks; of several with one key the first by `order`. Reduced before the shuffle."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])
    return first.join(old.select(*keys), keys, "left_anti").select(*new.columns)


def call_ledger(calls: DataFrame, args: Column, result: Column) -> DataFrame:
    """calls with `args_preview` and `result_preview` (500 characters), `status`, and `error` (1000 characters) where the result starts with error."""
    failed = F.coalesce(F.lower(result).startswith("error"), F.lit(False))
    return calls.withColumns({"args_preview": F.left(args, F.lit(500)), "result_preview": F.left(result, F.lit(500)), "status": F.when(failed, "error").otherwise("success"), "error": F.when(failed, F.left(result, F.lit(1000)))})


def _where(table: DataFrame, where: dict) -> Column:
    parts = [F.col(f"`{identifier(k)}`").eqNullSafe(F.lit(v)) if v is not None else F.col(f"`{identifier(k)}`").isNull() for k, v in where.items()]
    out = parts[0]
    for p in parts[1:]:
        out &= p
    return out


def written(table: DataFrame, operation: str, data: dict | list[dict] | None = None, where: dict | None = None, generated: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a user table after an insert, update or delete; ValueError for what isn't allowed.

    insert: rows with the same columns; generated columns are left out and stay null, as do columns that no row names.
    update and delete: need a non-empty where (equal columns, null equals null).
    """
    rows = [data] if isinstance(data, dict) and data else list(data or [])
    if operation not in ("insert", "update", "delete"):
        raise ValueError(f"no such operation: {operation}")
    named = {c for r in rows for c in r} | set(where or {})
    for c in named:
        identifier(c)
    if unknown := named - set(table.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    if operation == "insert":
        if not any(rows):
            raise ValueError("an insert needs a row with columns")
        if any(set(r) != set(rows[0]) for r in rows):
            raise ValueError("rows of an insert need the same columns")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        new = [tuple(None if c in generated else r.get(c) for c in table.columns) for r in rows]
        return table.unionByName(table.sparkSession.createDataFrame(new, schema))
    if not where:
        raise ValueError(f"{operation} needs a non-empty where")
    hit = _where(table, where)
    if operation == "delete":
        return table.where(~hit)
    if len(rows) != 1:
        raise ValueError("an update needs one object of values")
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.when(hit, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in rows[0].items()})
