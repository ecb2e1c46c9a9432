"""Queries of predicates, text, JSON and transitions that the other modules don't show."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.functions import json, text
from fathom.operators import records, runs, sessions, state, structure
from fathom.operators.claims import WorkTable
from fathom.operators.metadata import MetadataTable
from fathom.plans.registry import query
from fathom.session import shared_folder

# -- predicates -----------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
def time_window(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.events.where((F.col("ts") >= at("2024-01-10 00:00:00")) & (F.col("ts") < at("2024-01-12 06:00:00"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1996-03-01' + INTERVAL 1 DAY AND o_orderdate >= DATE '1996-03-01' - INTERVAL 30 DAY")
def until_date(t):
    """The last date counts with all its hours."""
    day = F.lit("1996-03-01").cast("date")
    return t.orders.where((F.col("o_orderdate") < F.date_add(day, 1).cast("timestamp_ntz")) & (F.col("o_orderdate") >= F.date_sub(day, 30).cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def not_in_list(t):
    return t.orders.where(~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query(r"SELECT event_id FROM events WHERE CAST(props AS VARCHAR) LIKE '%\_%' ESCAPE '\' OR event_type ILIKE '%_UR%'")
def like_literal(t):
    """An escaped wildcard is a character; an open one is not."""
    return t.events.where(F.col("props").like(f"%{text.escape_like('_')}%") | F.col("event_type").ilike("%_UR%")).select("event_id")


@query("SELECT event_id FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) WHERE k IN (5, 7) AND event_type <> 'view'")
def json_containment(t):
    """Objects in arrays in objects: what is contained, at any depth."""
    k = json.field(F.col("props"), "k").cast("int")
    held = F.to_json(F.struct(F.struct(F.array(F.struct(k.alias("k"), F.lit("x").alias("y")), F.struct(F.lit(-1).alias("k"), F.lit(None).cast("string").alias("y"))).alias("list")).alias("in"), F.array("event_type", F.lit("z")).alias("tags")))
    any_of = json.contains(held, {"in": {"list": [{"k": 5, "y": "x"}]}}) | json.contains(held, {"in": {"list": [{"k": 7}, {"k": -1}]}, "tags": ["z"]})
    return t.events.where(any_of & ~json.contains(held, {"tags": ["view"]})).select("event_id")


# -- text -----------------------------------------------------------------------------


@query("SELECT doc_id, left(text, 300) AS excerpt, CASE WHEN length(text) > 500 THEN left(text, 500) || '... [truncated]' ELSE text END AS dropped FROM documents")
def excerpts(t):
    return t.documents.select("doc_id", text.preview(F.col("text"), 300).alias("excerpt"), text.marked_cut(F.col("text")).alias("dropped"))


@query("SELECT conv_id, turn, CASE WHEN turn = 2 THEN '1,2' ELSE '2' END AS valid, text || ' [2] ' || CASE WHEN turn = 2 THEN '[1]' ELSE '' END || '' AS told FROM conversations")
def citation_check(t):
    """Sources 1 and 2 are known; a message cites 2, its turn's neighbours and an unknown one."""
    extra = F.when(F.col("turn") == 2, "[1]").otherwise("[77]")
    marked, known = F.concat("text", F.lit(" [2] "), extra), F.array(F.lit("2"), F.lit("1"))
    return t.conversations.select("conv_id", "turn", F.array_join(text.valid_citations(marked, known), ",").alias("valid"), text.strip_unknown(marked, known).alias("told"))


@query()
def strip_markdown(t):
    """Each document as markdown of several constructs; tested against plain code."""
    marked = F.concat(F.lit("# "), F.left("text", F.lit(20)), F.lit("\n\n**bold** and [link](http://x) `a*b*`\n```py\n# kept *as is*\n```\n> "), F.left("text", F.lit(200)))
    return t.documents.select("doc_id", text.plain_text(marked).alias("plain"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Of ' || lang WHEN 1 THEN source WHEN 2 THEN 'f' ELSE 'f' END AS title FROM documents")
def doc_title(t):
    """Heading, title line, blank title, neither."""
    n = F.col("doc_id") % 4
    body = F.when(n == 0, F.concat(F.lit("intro\n# Of "), "lang", F.lit("  \ntitle: x"))).when(n == 1, F.concat(F.lit("---\nTitle: \""), "source", F.lit("\"\n# late"))).when(n == 2, "title:  \n# late").otherwise("## no")
    return t.documents.select("doc_id", text.document_title(body, F.lit("f")).alias("title"))


@query("SELECT doc_id, left(split_part(text, chr(10), 1), 160) AS note FROM documents")
def error_notes(t):
    return t.documents.select("doc_id", text.first_line(F.col("text")).alias("note"))


@query("SELECT doc_id, CASE WHEN regexp_replace(left(text, 20), '[^A-Za-z0-9._-]+', '_', 'g') = left(text, 20) THEN left(text, 20) ELSE regexp_replace(left(text, 20), '[^A-Za-z0-9._-]+', '_', 'g') || '_' || left(sha256(left(text, 20)), 8) END AS name FROM documents")
def file_names(t):
    return t.documents.select("doc_id", text.safe_file_name(F.left("text", F.lit(20))).alias("name"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS asserted FROM conversations")
def launch_claims(t):
    """A claim, a question and a negation take turns; the message, without its sentences' ends, stands before each."""
    said = F.element_at(F.array(F.lit("I have launched it now"), F.lit("I have launched it now?"), F.lit("I have not launched it")), (F.col("turn") % 3 + 1).cast("int"))
    claim = text.asserts(F.concat(F.lit("Well! "), said), [r"\bi have (?:just )?(?:not )?launched\b"], [r"\bi will launch\b"], r"\bnot\b", r"\b(?:if|would you)\b")
    return t.conversations.select("conv_id", "turn", claim.alias("asserted"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_custkey * 1000 + 7 END AS ms FROM orders")
def latencies(t):
    """Runs that end a customer's number of seconds and some microseconds after they began; open ones last."""
    began = F.col("o_orderdate").cast("timestamp")
    ended = F.when(F.col("o_orderstatus") != "O", began + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_custkey") + 0.0079).cast("decimal(18,6)")))
    return t.orders.select("o_orderkey", runs.latency_ms(began, ended).alias("ms"))


# -- JSON -----------------------------------------------------------------------------


@query("""SELECT event_id, '{"a":{"b":[1,2]},"k":' || CASE WHEN user_id % 2 = 0 THEN '"new"' ELSE props->>'$.k' END || '}' AS merged FROM events""")
def json_merge(t):
    """The right object wins; nested values stay as they are."""
    right = F.when(F.col("user_id") % 2 == 0, '{"k": "new"}').otherwise("{}")
    held = json.merged(json.merged(json.as_map(F.lit('{"a": {"b": [1, 2]}}')), json.as_map(F.col("props"))), json.as_map(right))
    return t.events.select("event_id", F.to_json(held).alias("merged"))


@query("""SELECT event_id, '{"a":{"b":[' || user_id || ']}}' AS kept, '{"n":{"c":"x"}}' AS moved, event_type = 'view' AS has FROM events""")
def json_nested_keys(t):
    """Keys of nested objects move as they stand; nulls are left out."""
    held = F.concat(F.lit('{"a": {"b": ['), F.col("user_id").cast("string"), F.lit(']}, "n": {"c": "x"}, "z": null'), F.when(F.col("event_type") == "view", ', "v": null').otherwise(""), F.lit("}"))
    rest = F.to_json(json.without_nulls(F.to_json(json.without(held, ["n"]))))
    return t.events.select("event_id", rest.alias("kept"), F.to_json(json.only(held, ["n"])).alias("moved"), json.has_any(held, ["v", "w"]).alias("has"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{"enabled":false}' WHEN 1 THEN '{"cron":{"at":[1]},"enabled":false}' ELSE '[1]' END AS config FROM customer""")
def json_set(t):
    """Schedules are switched off: one without settings, one that was on, one that is no object."""
    n = F.col("c_custkey") % 3
    config = F.when(n == 1, '{"enabled": true, "cron": {"at": [1]}}').when(n == 2, "[1]")
    return t.customer.select("c_custkey", json.with_field(config, "enabled", F.lit("false")).alias("config"))


@query("SELECT event_id, event_type IN ('view', 'click') AS is_array FROM events")
def json_arrays(t):
    kind = F.when(F.col("event_type") == "view", "[]").when(F.col("event_type") == "click", ' [{"a": 1}]').when(F.col("event_type") == "error", "[bad").otherwise('{"a": [1]}')
    return t.events.select("event_id", json.is_array(kind).alias("is_array"))


@query("SELECT event_id, CAST(CASE user_id % 3 WHEN 0 THEN user_id WHEN 1 THEN 4 END AS INTEGER) AS prompt_tokens, CAST(CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 END AS INTEGER) AS completion_tokens, CAST(CASE user_id % 3 WHEN 0 THEN user_id + 2 WHEN 1 THEN 50 END AS INTEGER) AS total_tokens FROM events")
def usage_flatten(t):
    """Usage at the top without a total, nested with one, none."""
    n, own = F.col("user_id") % 3, F.col("user_id").cast("string")
    told = F.when(n == 0, F.concat(F.lit('{"prompt_tokens": '), own, F.lit(', "completion_tokens": "2"}'))).when(n == 1, '{"usage": {"prompt_tokens": 4, "completion_tokens": 5}, "total_tokens": 50}').otherwise("{}")
    return t.events.select("event_id", *json.usage(told))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE left(text, 500) END AS arguments FROM conversations")
def full_or_preview(t):
    """Even turns keep the whole text."""
    full = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return t.conversations.select("conv_id", "turn", json.full_or_preview(full, text.preview(F.col("text"))).alias("arguments"))


# -- transitions ----------------------------------------------------------------------

_RUNS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'indexing' WHEN 'F' THEN 'indexed' ELSE 'pending' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'me' ELSE 'other' END AS owner, CAST(left(o_orderpriority, 1) AS INTEGER) AS attempts FROM orders"


def _runs(t):
    """Orders as indexing runs, those of even customers ours; the priority counts attempts."""
    status = F.when(F.col("o_orderstatus") == "O", "indexing").when(F.col("o_orderstatus") == "F", "indexed").otherwise("pending")
    return t.orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_custkey") % 2 == 0, "me").otherwise("other").alias("owner"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("attempts"))


@query(f"SELECT id, CASE WHEN status = 'indexing' AND owner = 'me' THEN 'indexed' ELSE status END AS status FROM ({_RUNS})")
def fenced_finish(t):
    return state.finished(_runs(t), "me", "indexed").select("id", "status")


@query(f"""SELECT id, CASE WHEN status <> 'pending' THEN status WHEN attempts <= 2 THEN 'indexed' WHEN attempts + 1 > 4 THEN 'failed' ELSE 'indexing' END AS status,
  CASE WHEN status <> 'pending' THEN owner WHEN attempts <= 2 THEN 'a' ELSE 'b' END AS owner, CAST(attempts + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS INTEGER) AS attempts
  FROM ({_RUNS})""")
def claims_committed(t):
    """Two workers claim from one table; each finishes what it still owns, and what it tries on the other's rows changes nothing."""
    work = WorkTable(t.spark, f"{shared_folder(t.spark)}/work-{uuid.uuid4().hex}", "id")
    work.create(_runs(t))
    work.claim("a", F.col("attempts") <= 2)
    work.claim("b")
    work.claim("a")  # nothing is left
    work.finish("a", "indexed")
    work.finish("b", "failed", F.col("attempts") > 4)
    work.finish("c", "failed")
    return work.rows()


@query(f"SELECT id, CASE WHEN status = 'indexing' AND owner = 'me' THEN CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END ELSE status END AS status, CASE WHEN status = 'indexing' AND owner = 'me' AND attempts < 3 THEN NULL ELSE owner END AS owner FROM ({_RUNS})")
def bounded_retry(t):
    return state.retried(_runs(t), "me").select("id", "status", "owner")


@query(f"SELECT id, 'enriching' AS status, CASE WHEN status = 'indexing' THEN owner ELSE 'now' END AS owner, CASE WHEN status <> 'indexing' THEN status END AS prior FROM ({_RUNS})")
def enrich_claim(t):
    """Runs that are indexing stand for those already being enriched."""
    rows = _runs(t).withColumns({"status": F.when(F.col("status") == "indexing", "enriching").otherwise(F.col("status")), "prior": F.lit(None).cast("string")})
    return state.enriching(rows, "now").select("id", "status", "owner", "prior")


@query("SELECT 'unenriched' AS choice, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'failed', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'all', doc_id FROM documents")
def work_sets(t):
    """Toxic labels are enrichments that failed."""
    results = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("error"))
    return state.work_sets(t.documents.select("doc_id"), results, "doc_id").select("choice", "doc_id")


@query("""SELECT CAST(doc_id AS VARCHAR) AS item_id, 'full_document' AS item_type, toxic = 1 AS toxic, CASE WHEN lang = 'de' AND source IN ('src1', 'src2') THEN source END AS source,
  CASE WHEN lang = 'de' THEN CAST(quality AS VARCHAR) ELSE CAST(CAST(quality AS DOUBLE) AS VARCHAR) END AS quality
FROM labels JOIN documents USING (doc_id) WHERE source <> 'src3' OR lang = 'de'""")
def metadata_versions(t):
    """Labels as answers under two lists of fields: a number becomes a text, a choice is added. German documents are answered again under the second list, after one
    source's rows were removed."""
    table = MetadataTable(t.spark, f"{shared_folder(t.spark)}/metadata-{uuid.uuid4().hex}")
    docs = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    said = F.when(F.col("toxic") == 1, "yes").otherwise("No")
    answers = lambda rows, *more: rows.select(F.col("doc_id").alias("item_id"), F.lit("full_document").alias("item_type"), F.to_json(F.struct("quality", said.alias("toxic"), *more)).alias("answer"), F.lit(None).cast("string").alias("error"))
    field = lambda name, kind, **more: {"name": name, "type": kind, "description": name} | more
    table.define([field("quality", "number"), field("toxic", "boolean")])
    table.enrich(answers(docs))
    table.define([field("toxic", "boolean"), field("source", "enum", enum_values=["src1", "src2"]), field("quality", "text")])
    table.remove(docs.where("source = 'src3'").select(F.col("doc_id").alias("item_id")))
    table.enrich(answers(docs.where("lang = 'de'"), "source"))
    return table.rows().select("item_id", "item_type", "toxic", "source", "quality")


@query("SELECT 'orders' AS kind, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def cascade_delete(t):
    """Customers of one segment go, and their orders with them."""
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    left = state.cascade({"orders": t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id")), "customers": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"))}, gone, "key")
    return left["orders"].select(F.lit("orders").alias("kind"), "id").unionByName(left["customers"].select(F.lit("customers").alias("kind"), "id"))


@query("SELECT n_nationkey, array_to_string(list_sort(list_intersect([1, 2, 3, n_nationkey], [2, 3, 9])), ',') AS both_, array_to_string(list_sort(list_filter([1, 2, 3, n_nationkey], lambda x: x NOT IN (2, 3, 9))), ',') AS only_left FROM nation WHERE n_nationkey > 3")
def set_differences(t):
    """Array arithmetic on ids of each row."""
    left, right = F.array(F.lit(1), F.lit(2), F.lit(3), F.col("n_nationkey")), F.array(F.lit(2), F.lit(3), F.lit(9))
    return t.nation.where("n_nationkey > 3").select("n_nationkey", F.array_join(F.array_sort(F.array_intersect(left, right)), ",").alias("both_"), F.array_join(F.array_sort(F.array_except(left, right)), ",").alias("only_left"))


_SEED = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, role, text FROM conversations"


@query(f"""WITH m AS ({_SEED}), x AS (SELECT conv_id, p, CASE WHEN role <> CASE WHEN p % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'role' WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN length(text) > 300 THEN 'too long' END AS problem FROM m
UNION ALL SELECT conv_id, -1, CASE WHEN count(*) > 5 THEN 'too many' WHEN count(*) % 2 <> 0 THEN 'odd' END FROM m GROUP BY 1)
SELECT conv_id, min(p) AS position, min_by(problem, p) AS problem FROM x WHERE problem IS NOT NULL GROUP BY 1""")
def seed_validation(t):
    """Conversations to import, of 5 messages and 300 characters at most."""
    from pyspark.sql import Window

    rows = t.conversations.withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return sessions.seed_problems(rows, "conv_id", "p", 5, 300)


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 3 THEN 'unknown' ELSE 'agent' END AS type, CASE WHEN n_nationkey % 4 = 3 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS name, CASE n_nationkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'success' END AS status FROM nation")
def block_logs(t):
    """Nations are blocks: without a result, with an error, with one, and a result of a block that isn't there."""
    n = F.col("n_nationkey") % 4
    blocks = t.nation.where(n != 3).select(F.col("n_nationkey").alias("id"), F.lit("agent").alias("type"), F.col("n_name").alias("name"))
    results = t.nation.where(n != 0).select(F.col("n_nationkey").alias("id"), F.when(n == 1, '{"error": null}').otherwise('{"value": {"error": 1}}').alias("output"))
    return records.block_logs(blocks, results).select("id", "type", "name", "status")


@query("SELECT o_orderkey AS id, o_orderpriority AS type FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def unknown_block_types(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"))
    return records.unknown_types(rows, ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("""WITH h AS (SELECT doc_id, chr(10) || '# A' || chr(10) || text || chr(10) || '## B ' || lang || chr(10) || left(text, 30) AS body FROM documents WHERE length(text) > 0 AND NOT regexp_matches(text, '(?m)^#{1,6}[ \\t]')),
s AS (SELECT doc_id, 1 AS section, 'A' AS heading, '# A' || chr(10) || text || chr(10) AS s FROM h JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 2, 'B ' || lang, '## B ' || lang || chr(10) || left(text, 30) FROM h JOIN documents USING (doc_id))
SELECT doc_id, section, heading, i::INTEGER AS chunk_index, substring(s, i * 1950 + 1, 2000) AS text FROM (SELECT *, unnest(range(greatest(1, ceil((length(s) - 50) / 1950)::BIGINT))) AS i FROM s)""")
def chunk_markdown(t):
    """Documents without headings of their own, under one and before another."""
    plain = t.documents.where((F.length("text") > 0) & ~F.col("text").rlike(r"(?m)^#{1,6}[ \t]"))
    body = F.concat(F.lit("\n# A\n"), "text", F.lit("\n## B "), "lang", F.lit("\n"), F.left("text", F.lit(30)))
    return structure.header_chunks(plain.select("doc_id", body.alias("text")), "doc_id", "text")


@query("""WITH e AS (SELECT l_orderkey AS request, l_linenumber AS position, nullif(l_suppkey % 9, 0) AS id, CAST(l_quantity * 3 - 6 AS INTEGER) AS top_k, l_discount * 11 AS threshold FROM lineitem),
p AS (SELECT request, position, CASE WHEN id IS NULL THEN 'no id' WHEN position > min(position) OVER (PARTITION BY request, id) THEN 'id twice' WHEN top_k < 1 OR top_k > 100 THEN 'top_k'
  WHEN threshold < 0 OR threshold > 1 THEN 'threshold' END AS problem FROM e
  UNION ALL SELECT request, -1, 'too many' FROM e GROUP BY 1 HAVING count(*) > 6)
SELECT request, CAST(m.position AS BIGINT) AS position, m.problem AS problem FROM (SELECT request, min({'position': position, 'problem': problem}) AS m FROM p WHERE problem IS NOT NULL GROUP BY 1)""")
def request_violations(t):
    """Orders are requests, their lines the knowledge bases that they name."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("position"), F.nullif(F.col("l_suppkey") % 9, F.lit(0)).alias("id"), (F.col("l_quantity") * 3 - 6).cast("int").alias("top_k"), (F.col("l_discount") * 11).alias("similarity_threshold"))
    return records.request_violations(rows, "request", "position", 6)
