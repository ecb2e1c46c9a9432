"""Queries over the tables of a folder, with the SQL of the same results.

No table holds nodes, items or run states; queries that need them derive them from
columns of all rows, the same way in the SQL, as their docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from fathom.functions import json, text, vectors
from fathom.operators import listings, records, retrieval, runs, sessions, sparse, state, structure
from fathom.sources import sinks
from fathom.plans.indexes import documents_index
from fathom.plans.registry import KNOWN, query
from fathom.sources.tables import links

#: The clock of the queries that look back from now.
NOW = "2024-01-20 00:00:00"


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in KNOWN.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in KNOWN.items() if sql}


# -- text ---------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY 2")
def dedup_content(t):
    return state.first_of_content(t.documents, "doc_id", F.col("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS description, left(text, 500) AS preview FROM documents")
def previews(t):
    return t.documents.select("doc_id", text.shortened(F.col("text")).alias("description"), text.preview(F.col("text")).alias("preview"))


@query(r"SELECT conv_id, turn, array_to_string(list_distinct_in_order, ',') AS cited, trim(regexp_replace(marked, '\s*\[\d+\]', '', 'g')) AS bare FROM (SELECT *, text || ' [' || turn || '] [7] [' || turn || ']' AS marked, CASE WHEN turn = 7 THEN ['7'] ELSE [CAST(turn AS VARCHAR), '7'] END AS list_distinct_in_order FROM conversations)")
def citation_parse(t):
    """Markers [turn] [7] [turn] are put behind each message."""
    turn = F.concat(F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    marked = t.conversations.withColumn("marked", F.concat("text", turn, F.lit(" [7]"), turn))
    return marked.select("conv_id", "turn", F.array_join(text.citations(F.col("marked")), ",").alias("cited"), text.without_citations(F.col("marked")).alias("bare"))


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')), 0) AS n_tokens, CAST(greatest(1, (length(text) // 4 + 999) // 1000) AS BIGINT) AS units FROM documents")
def billing_units(t):
    units = F.greatest(F.lit(1), F.floor((text.token_estimate(F.col("text")) + 999) / 1000))
    return t.documents.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), units.cast("long").alias("units"))


@query(r"SELECT event_id, TRY_CAST(nullif(props->>'$.k', '') AS INTEGER) AS k FROM events")
def usage_unpack(t):
    return t.events.select("event_id", json.as_int(json.field(F.col("props"), "k")).alias("k"))


@query("SELECT event_id FROM events WHERE props->>'$.k' = '5'")
def json_filter(t):
    return t.events.where(json.matches(F.col("props"), {"k": 5})).select("event_id")


# -- listings and rollups -------------------------------------------------------


@query("SELECT count(*) AS n_docs, round(coalesce(avg(length(text)), 0), 6) AS avg_length FROM documents")
def corpus_stats(t):
    return t.documents.agg(F.count("*").alias("n_docs"), F.round(F.coalesce(F.avg(F.length("text")), F.lit(0.0)), 6).alias("avg_length"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def status_pivot(t):
    done = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("total"), done("O").alias("open"), done("F").alias("finished"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished FROM orders")
def source_counts(t):
    """Statuses other than O and F count into the total only."""
    return t.orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"))


@query("SELECT n.n_nationkey, n.n_name, coalesce(s.c, 0) AS suppliers, coalesce(c.c, 0) AS customers FROM nation n LEFT JOIN (SELECT s_nationkey k, count(*) c FROM supplier GROUP BY 1) s ON s.k = n.n_nationkey LEFT JOIN (SELECT c_nationkey k, count(*) c FROM customer GROUP BY 1) c ON c.k = n.n_nationkey")
def kb_listing(t):
    n = lambda rows, key, name: rows.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
    both = t.nation.join(n(t.supplier, "s_nationkey", "suppliers"), "n_nationkey", "left").join(n(t.customer, "c_nationkey", "customers"), "n_nationkey", "left")
    return both.select("n_nationkey", "n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT c_custkey, c_name, count(o_orderkey) AS runs, max(o_orderdate) AS last_run FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def agent_listing(t):
    runs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"), F.max("o_orderdate").alias("last_run"))
    return t.customer.join(runs, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("runs", F.lit(0)).alias("runs"), "last_run")


@query("SELECT c_custkey, count(o_orderkey) AS runs, coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') AS last_activity FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(o_orderkey) <= 6")
def session_listing(t):
    """Customers are sessions, urgent orders their runs; sessions without runs are listed too."""
    runs_ = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"), F.max("o_orderdate").alias("last"))
    both = t.customer.select("c_custkey").join(runs_, "c_custkey", "left")
    return both.select("c_custkey", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("last", F.lit("1970-01-01").cast("timestamp_ntz")).alias("last_activity")).where("runs <= 6")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def session_search(t):
    big = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_hit", F.lit(True))
    return t.customer.join(big, "c_custkey", "left").where(text.contains_literal(F.col("c_name"), "00012") | F.col("_hit").isNotNull()).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def sources_excluding_kb(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_semi(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unenriched_items(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0")
def failed_items(t):
    """A label of quality 0 stands for an enrichment error."""
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 0").select("doc_id"), "doc_id")


_STATUS = "SELECT source, count(quality) FILTER (WHERE quality = 1) AS ok, count(quality) FILTER (WHERE quality = 0) AS failed, count(*) AS items FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"


@query(f"SELECT *, CASE WHEN failed = 0 THEN 'completed' WHEN ok = 0 THEN 'failed' ELSE 'completed_with_errors' END AS status FROM ({_STATUS})")
def enrichment_status(t):
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").groupBy("source")
    counts = rows.agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("failed"), F.count("*").alias("items"))
    return counts.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("ok") == 0, "failed").otherwise("completed_with_errors"))


@query("""SELECT doc_id, CASE WHEN quality IS NOT NULL THEN '{"quality":' || quality || ',"toxic":' || toxic || '}' END AS enrichment FROM documents LEFT JOIN labels USING (doc_id)""")
def enrich_attach(t):
    packed = json.packed(quality=F.col("quality"), toxic=F.col("toxic"))
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id", "left").select("doc_id", packed.alias("enrichment"))


@query("SELECT c_mktsegment, count(DISTINCT o_custkey) AS active FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def mau_counts(t):
    buyers = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(buyers, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("active"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_list(t):
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("SELECT event_id, event_type FROM events ORDER BY (event_type = 'error') DESC, ts DESC, event_id LIMIT 100")
def failed_first(t):
    return t.events.orderBy(F.desc(F.col("event_type") == "error"), F.desc("ts"), "event_id").limit(100).select("event_id", "event_type")


@query("""SELECT 'document' AS kind, doc_id AS item_id, length(text) AS n FROM documents UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark UNION ALL SELECT 'page', page_id, length(html) FROM pages
UNION ALL SELECT 'message', conv_id * 1000 + turn, length(text) FROM conversations UNION ALL SELECT 'customer', c_custkey, length(c_name) FROM customer""")
def content_union(t):
    """Five tables of content, each with a text column of its own name."""
    part = lambda rows, kind, item, body: rows.select(F.lit(kind).alias("kind"), item.alias("item_id"), F.length(body).cast("long").alias("n"))
    message = F.col("conv_id") * 1000 + F.col("turn")
    out = part(t.documents, "document", F.col("doc_id"), "text").unionByName(part(t.benchmark, "benchmark", F.col("item_id"), "text")).unionByName(part(t.pages, "page", F.col("page_id"), "html"))
    return out.unionByName(part(t.conversations, "message", message, "text")).unionByName(part(t.customer, "customer", F.col("c_custkey"), "c_name"))


@query("SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 500")
def filter_options(t):
    return t.events.select("event_type").distinct().orderBy("event_type").limit(500)


@query("SELECT event_type, count(*) AS calls, round(sum(value), 2) AS tokens, round(quantile_cont(round(value, 2), 0.95), 6) AS p95 FROM events GROUP BY 1")
def tool_stats(t):
    """p95 over values in hundredths, whose number bounds the state of a group."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("tokens"), F.round(F.percentile(F.round("value", 2), F.lit(0.95)), 6).alias("p95"))


@query(f"SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS runs_day, count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND event_type = 'error') AS failed_day, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) AS last_run FROM events WHERE ts < TIMESTAMP '{NOW}'")
def health_card(t):
    now = F.lit(NOW).cast("timestamp_ntz")
    day, failed = F.col("ts") >= now - F.expr("INTERVAL 24 HOURS"), F.col("event_type") == "error"
    return t.events.where(F.col("ts") < now).agg(F.count_if(day).alias("runs_day"), F.count_if(day & failed).alias("failed_day"), F.count_if(failed).alias("failed"), F.max("ts").alias("last_run"))


def _buckets(unit: str):
    sql = f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value), 2) AS tokens, max(ts) AS last_run FROM events GROUP BY 1"

    def run(t):
        rows = t.events.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"))
        return rows.agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 2).alias("tokens"), F.max("ts").alias("last_run"))

    run.__name__ = f"run_buckets_{unit}"
    return query(sql)(run)


for _unit in ("minute", "hour", "day"):
    _buckets(_unit)


# -- sessions -------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4) WHERE turn >= s")
def trailing_history(t):
    return sessions.trailing_history(t.conversations, "conv_id", "turn", 4).select("conv_id", "turn", "role")


_POS = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role IN ('user', 'assistant')"


@query(f"SELECT conv_id, turn, position FROM ({_POS}) WHERE role <> CASE WHEN position % 2 = 0 THEN 'user' ELSE 'assistant' END OR coalesce(trim(text), '') = ''")
def alternation_check(t):
    return sessions.misplaced(t.conversations, "conv_id", "turn").select("conv_id", "turn", "position")


@query(f"SELECT conv_id, position // 2 AS pair, max(text) FILTER (WHERE position % 2 = 0) AS question, max(text) FILTER (WHERE position % 2 = 1) AS answer FROM ({_POS}) GROUP BY 1, 2")
def message_pairs(t):
    return sessions.pairs(t.conversations, "conv_id", "turn")


@query("SELECT conv_id, left(min_by(text, turn), 100) AS first_message, count(*) AS n_messages FROM conversations GROUP BY 1")
def session_first_message(t):
    return sessions.first_messages(t.conversations, "conv_id", "turn")


@query("WITH s AS (SELECT user_id, ts, event_id, event_type = 'error' AS f, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT user_id, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last, count(*) AS length FROM s WHERE f GROUP BY user_id, g HAVING count(*) >= 2")
def error_streaks(t):
    return sessions.streaks(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)


# -- retrieval --------------------------------------------------------------------

_VEC = "SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_SOURCES = f"v AS ({_VEC}), b AS (SELECT label, max(score) AS best FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), p AS (SELECT v.*, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM v SEMI JOIN b USING (label))"


def _scored(t):
    """Embeddings by likeness to vector 0; the label is the source."""
    asked = t.embeddings.where("vec_id = 0").select("embedding").first()
    vector = vectors.literal(asked[0]) if asked and asked[0] else F.lit(None).cast("array<double>")
    return retrieval.vector_scores(t.embeddings, vector).select("vec_id", "label", "score")


@query(f"{_VEC} ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(t):
    return retrieval.top(_scored(t), "vec_id", 10)


@query(f"WITH {_SOURCES} SELECT vec_id, label, score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3")
def vector_per_source(t):
    return retrieval.per_source(_scored(t), "label", "vec_id", 3, 5).select("vec_id", "label", "score", "place")


@query(f"WITH v AS ({_VEC}), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r, max(score) OVER (PARTITION BY label) AS best FROM (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 200)) SELECT vec_id, label, score FROM p WHERE r <= 3 ORDER BY r <= 1 DESC, CASE WHEN r <= 1 THEN best END DESC NULLS LAST, score DESC, vec_id LIMIT 15")
def source_limits(t):
    return retrieval.source_limits(retrieval.top(_scored(t), "vec_id", 200), "label", "vec_id", 15, most=3, least=1)


@query(f"WITH {_SOURCES}, m AS (SELECT vec_id, label, score FROM v ORDER BY score DESC, vec_id LIMIT 5), x AS (SELECT vec_id, label, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM p WHERE place <= 1 AND vec_id NOT IN (SELECT vec_id FROM m)) SELECT vec_id, label, score, false AS source_floor FROM m UNION ALL SELECT vec_id, label, round((SELECT min(score) FROM m) - 0.01 * r, 6), true FROM x")
def floor_merge(t):
    rows = _scored(t)
    floor = retrieval.per_source(rows, "label", "vec_id", 1, 5).select("vec_id", "label", "score")
    return retrieval.with_floor(retrieval.top(rows, "vec_id", 5), floor, "vec_id")


_BM25 = r"""tok AS (SELECT doc_id, lang, source, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents),
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS t FROM benchmark WHERE item_id = 0),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok),
tf AS (SELECT doc_id, dl, t, count(*) AS f FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM tok) SEMI JOIN q USING (t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, round(sum(ln(greatest(1, (n - df + 0.5) / (df + 0.5))) * f / (f + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (t), st GROUP BY 1)"""


def _terms(t):
    """The words of benchmark item 0."""
    asked = t.benchmark.where("item_id = 0").select("text").first()
    return retrieval.query_terms(asked[0]) if asked and asked[0] else []


def _bm25(t):
    """(doc_id, score) of the documents by the words of benchmark item 0, from the stored index."""
    return sparse.scores(documents_index(t), _terms(t)).select(F.col("item").alias("doc_id"), "score")


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(t):
    return retrieval.top(_bm25(t), "doc_id", 10)


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_scan(t):
    """The same without an index: the fallback of a knowledge base that has none."""
    rows = sparse.retriever(sparse.IndexRetriever(t.spark, f"{t.folder}/no-index"), sparse.ScanRetriever(t.documents, "doc_id", "text"), 1)
    return rows.search(_terms(t), 10).withColumnRenamed("item", "doc_id")


@query(f"WITH {_BM25}, x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20)), y AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM ({_VEC} ORDER BY score DESC, e.vec_id LIMIT 20)) SELECT doc_id, round(coalesce(0.5 / (60 + y.r), 0) + coalesce(0.5 / (60 + x.r), 0), 6) AS score FROM x FULL JOIN y USING (doc_id)")
def hybrid_rrf(t):
    """A vector's id is taken as that of the document it embeds."""
    near = retrieval.top(_scored(t).select(F.col("vec_id").alias("doc_id"), "score"), "doc_id", 20)
    return retrieval.fused(near, retrieval.top(_bm25(t), "doc_id", 20), "doc_id")


_GROUPS = f"{_BM25}, g AS (SELECT doc_id, source, score, length(text) // 4 AS est, max(score) OVER (PARTITION BY source) AS best, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50) JOIN documents USING (doc_id))"


def _fifty(t):
    return retrieval.fetched(t.documents.select("doc_id", "source", "text"), "doc_id", retrieval.top(_bm25(t), "doc_id", 50))


@query(f"WITH {_GROUPS} SELECT doc_id, source, score, best FROM g")
def group_by_document(t):
    return retrieval.by_document(_fifty(t).drop("text"), "doc_id", "source").select("doc_id", "source", "score", "best")


@query(f"WITH {_GROUPS}, c AS (SELECT *, CAST(sum(est + CASE WHEN r = 1 THEN 20 ELSE 0 END) OVER (ORDER BY best DESC, source, score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM g) SELECT doc_id, running FROM c WHERE running <= 8000")
def token_budget(t):
    return retrieval.within_budget(_fifty(t), "doc_id", "source", "text", 8000, 20).select("doc_id", "running")


_PAGES = "p AS (SELECT o_custkey, o_orderkey, unnest(range(day(o_orderdate), day(o_orderdate) + 3)) AS page FROM orders)"


@query(f"WITH {_PAGES}, f AS (SELECT DISTINCT min(o_orderkey) AS o_orderkey FROM p GROUP BY o_custkey, page) SELECT o_orderkey, f.o_orderkey IS NOT NULL AS fresh FROM orders o LEFT JOIN f USING (o_orderkey)")
def page_overlap(t):
    """Orders are items of a customer's source; they cover the pages of their day and the two after."""
    day = F.dayofmonth("o_orderdate")
    return retrieval.fresh_pages(t.orders.select("o_custkey", "o_orderkey", F.sequence(day, day + 2).alias("pages")), "o_custkey", "o_orderkey", "pages")


# -- structure ----------------------------------------------------------------------


@query("SELECT doc_id, i::INTEGER AS chunk_index, (i * 1950)::INTEGER AS start, substring(text, i * 1950 + 1, 2000) AS text FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 50) / 1950)::BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(t):
    return structure.chunks(t.documents, "doc_id", "text")


@query("SELECT doc_id, i::INTEGER AS chunk_index, length(substring(text, i * 3800 + 1, 4000)) AS n FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 200) / 3800)::BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def sliding_windows(t):
    return structure.chunks(t.documents, "doc_id", "text", 4000, 200).select("doc_id", "chunk_index", F.length("text").cast("long").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, page, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, length(line) AS n FROM l),
c AS (SELECT doc_id, i, i * 1950 AS s, i * 1950 + length(substring(text, i * 1950 + 1, 2000)) AS e FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 50) / 1950)::BIGINT))) AS i FROM documents WHERE length(text) > 0))
SELECT doc_id, i::INTEGER AS chunk_index, page::INTEGER AS page FROM c JOIN b USING (doc_id) WHERE s < f + n AND e > f""")
def chunk_pages(t):
    """A line of a document is one of its pages."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "line"))
    pages = lines.select("doc_id", (F.col("page") + 1).alias("page"), F.length("line").alias("n_chars"))
    return structure.pages_of_chunks(pages, structure.chunks(t.documents, "doc_id", "text"), "doc_id")


@query("SELECT vec_id, label, round(greatest(0, 1 - 0.02 * label - 0.05 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1))::DOUBLE, 6) AS score FROM embeddings")
def tree_score(t):
    """The label is the document's rank, nodes rank by id."""
    return structure.positional_scores(t.embeddings, "label", "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


def _nodes(t):
    """Parts as nodes of a tree: parent is the id div 10; references are id div 3 + 1 and id div 5 + 2."""
    n = F.col("p_partkey")
    parent = F.when(n >= 10, F.floor(n / 10).cast("long"))
    return t.part.select(n.alias("node_id"), parent.alias("parent_id"), F.array(F.floor(n / 3) + 1, F.floor(n / 5) + 2).alias("refs"))


_NODES = "n AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id, [p_partkey // 3 + 1, p_partkey // 5 + 2] AS refs FROM part)"


@query(f"WITH {_NODES}, r AS (SELECT DISTINCT node_id, parent_id, unnest(refs) AS ref FROM n) SELECT r.node_id, ref FROM r JOIN n k ON k.node_id = ref WHERE ref <> r.node_id AND ref IS DISTINCT FROM r.parent_id AND k.parent_id IS DISTINCT FROM r.node_id")
def valid_references(t):
    return structure.valid_references(_nodes(t))


@query(f"""WITH {_NODES}, s AS (SELECT p_partkey AS node_id, round(1 - p_size / 100.0, 6)::DOUBLE AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5),
m AS (SELECT min(score) AS m FROM s), x AS (SELECT DISTINCT unnest(refs) AS node_id FROM n SEMI JOIN s USING (node_id)),
a AS (SELECT node_id FROM n SEMI JOIN x USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM s)),
c AS (SELECT node_id FROM n WHERE parent_id IN (SELECT node_id FROM a) AND node_id NOT IN (SELECT node_id FROM s UNION ALL SELECT node_id FROM a))
SELECT node_id, score, 'seed' AS kind FROM s UNION ALL SELECT node_id, round(greatest(0, m - 0.01), 6), 'reference' FROM a, m UNION ALL SELECT node_id, round(greatest(0, m - 0.02), 6), 'child' FROM c, m""")
def graph_expand(t):
    """Seeds are the five dearest parts."""
    seeds = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select(F.col("p_partkey").alias("node_id"), F.round(1 - F.col("p_size") / 100, 6).alias("score"))
    return structure.expanded(seeds, _nodes(t))


@query("SELECT n_regionkey AS toc_id, string_agg(repeat('  ', d) || n_name, chr(10) ORDER BY n_nationkey) AS toc FROM (SELECT *, n_nationkey % 3 AS d FROM nation) GROUP BY 1")
def toc_render(t):
    """A region is a table of contents, its nations the entries, their depth the id mod 3."""
    rows = t.nation.select(F.col("n_regionkey").alias("toc_id"), F.col("n_nationkey").alias("node_id"), (F.col("n_nationkey") % 3).alias("depth"), F.col("n_name").alias("title"))
    return structure.rendered(rows, "toc_id")


# -- state ----------------------------------------------------------------------------


@query("SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS nation FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def upsert_rows(t):
    """Suppliers come, each twice, over the customers of the same number; the later of the two counts."""
    new = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit(2).alias("at"))
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit(0).alias("at"))
    return state.upserted(old, new.unionByName(new.withColumns({"nation": F.lit(-1), "at": F.lit(1)})), "id", ["at"]).select("id", "nation")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(t):
    return state.latest(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_RUNS = "r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'indexing' WHEN 'F' THEN 'indexed' ELSE 'pending' END AS status, o_custkey AS owner, CAST(left(o_orderpriority, 1) AS INTEGER) AS attempts FROM orders)"


def _runs(t):
    """Orders as indexing runs: the customer owns them, the priority counts attempts."""
    status = F.when(F.col("o_orderstatus") == "O", "indexing").when(F.col("o_orderstatus") == "F", "indexed").otherwise("pending")
    return t.orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_custkey").alias("owner"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("attempts"))


@query(f"WITH {_RUNS} SELECT id, CASE WHEN status = 'indexing' AND c_custkey IS NULL THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status FROM r LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = owner")
def orphan_recovery(t):
    """Owners with a balance above 0 are alive."""
    return state.recovered(_runs(t), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("owner"))).select("id", "status")


@query(f"WITH {_RUNS} SELECT id, CASE WHEN status = 'pending' THEN 'indexing' ELSE status END AS status, attempts + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS attempts FROM r")
def claim_pending(t):
    return state.claimed(_runs(t).withColumn("owner", F.col("owner").cast("string")), "me").select("id", "status", "attempts")


@query("SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'stale' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS action FROM (SELECT c_custkey k, c_nationkey h FROM customer) a FULL JOIN (SELECT s_suppkey k, s_nationkey h FROM supplier) b ON a.k = b.k")
def refresh_plan(t):
    """Customers are found, suppliers known; the nation is the content."""
    return state.refresh_plan(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("hash")), t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("hash")))


@query("SELECT lang, CASE WHEN count(*) = 0 THEN NULL WHEN count(quality) = 0 THEN 'absent' WHEN count(quality) <> count(*) THEN 'stale' ELSE 'ready' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def index_status(t):
    """A language's index holds its labelled documents."""
    n = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("now"), F.nullif(F.count("quality"), F.lit(0).cast("long")).alias("built"))
    return n.select("lang", state.index_status(F.col("built"), F.col("now")).alias("status"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def fixed_window_limit(t):
    return state.fixed_window(t.events, "user_id", "ts", "event_id", 2, "day").select("event_id", "accepted")


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, n, event_id, true AS accepted, [ts] AS held FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, len(list_filter(r.held, lambda x: x > o.ts - INTERVAL 1 HOUR)) < 2,
  CASE WHEN len(list_filter(r.held, lambda x: x > o.ts - INTERVAL 1 HOUR)) < 2 THEN list_append(list_filter(r.held, lambda x: x > o.ts - INTERVAL 1 HOUR), o.ts) ELSE r.held END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r""")
def rate_limit(t):
    """At most 2 events of a user in an hour; events without user or time are not judged."""
    return state.sliding_window(t.events, "user_id", "ts", "event_id", 2, 3600)


# -- records --------------------------------------------------------------------------

_CALLS = """c AS (SELECT event_id, unnest(CAST('[{"name":"' || event_type || '","ms":' || user_id || '},{"result":"Error: ' || event_type || '"}]' AS JSON[])) AS j, unnest([0, 1]) AS position FROM events),
calls AS (SELECT event_id, position, coalesce(j->>'$.name', 'unknown') AS name, CASE WHEN lower(j->>'$.result') LIKE 'error%' THEN 'error' ELSE 'success' END AS status, coalesce(CAST(j->>'$.ms' AS INTEGER), 0) AS ms FROM c)"""


def _calls(t):
    """Every event tells of two calls: one named by its type, one without a name that failed."""
    told = F.format_string('[{"name":"%s","ms":%d},{"result":"Error: %s"}]', "event_type", "user_id", "event_type")
    return records.tool_calls(t.events.withColumn("calls", told), "event_id", "calls")


@query(f"WITH {_CALLS} SELECT * FROM calls")
def tool_call_explode(t):
    return _calls(t)


@query(f"WITH {_CALLS} SELECT name, count(*) AS calls, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(ms) AS BIGINT) AS total_ms FROM calls GROUP BY 1")
def tool_call_summary(t):
    return records.call_summary(_calls(t), "name")


@query("SELECT o_orderkey, o_custkey, (SELECT string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS parts FROM orders")
def child_rollup(t):
    parts = records.children(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", "l_partkey", "parts")
    return t.orders.select("o_orderkey", "o_custkey").join(parts, "o_orderkey", "left")


@query("SELECT n_nationkey AS source, n_nationkey * 2 AS target FROM nation WHERE n_nationkey * 2 NOT IN (SELECT n_nationkey FROM nation)")
def edge_integrity(t):
    """Nations are blocks, each with an edge to twice its id."""
    n = F.col("n_nationkey")
    return records.dangling(t.nation.select(n.alias("source"), (n * 2).alias("target")), t.nation.select(n.alias("id")))


@query("SELECT b.n_nationkey AS id, string_agg(a.n_name, ',' ORDER BY a.n_nationkey) AS inputs FROM nation b LEFT JOIN nation a ON a.n_nationkey * 2 = b.n_nationkey OR a.n_nationkey + 1 = b.n_nationkey GROUP BY 1")
def block_upstream(t):
    """Nations are blocks, each with an edge to twice its id and one to the next."""
    n = F.col("n_nationkey")
    ends = t.nation.select(n.alias("source"), n.alias("at"), "n_name", F.explode(F.array_distinct(F.array(n * 2, n + 1))).alias("id"))
    return t.nation.select(n.alias("id")).join(records.children(ends, "id", "at", "n_name", "inputs"), "id", "left")


@query("""SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_acctbal >= 0 AND s_nationkey BETWEEN 3 AND 20 THEN CAST(s_nationkey AS VARCHAR) ELSE '7' END
WHEN 1 THEN CASE WHEN s_acctbal >= 0 AND s_nationkey BETWEEN 3 AND 20 THEN s_nationkey || '.5' ELSE '7' END
WHEN 2 THEN CASE WHEN s_acctbal >= 0 AND s_nationkey = 1 THEN 'true' ELSE 'false' END
ELSE CASE WHEN s_acctbal >= 0 AND s_nationkey IN (5, 6) THEN CAST(s_nationkey AS VARCHAR) ELSE '7' END END AS value FROM supplier""")
def settings_overlay(t):
    """Suppliers are settings of four kinds; their nation is what is stored, a word if they owe money."""
    kind = F.element_at(F.array(*map(F.lit, ("int", "float", "bool", "str"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    nation = F.col("s_nationkey").cast("string")
    stored = F.when(F.col("s_acctbal") < 0, "word").when(kind == "float", F.concat(nation, F.lit(".5"))).otherwise(nation)
    rule = t.supplier.select(F.col("s_suppkey").alias("key"), kind.alias("kind"), F.lit("7").alias("default"), F.lit(3.0).alias("low"), F.lit(20.5).alias("high"), F.when(kind == "str", F.array(F.lit("5"), F.lit("6"))).alias("choices"))
    return records.overlay(rule, t.supplier.select(F.col("s_suppkey").alias("key"), stored.alias("text")))


@query(f"SELECT user_id, max(ts) + INTERVAL 1 HOUR * (user_id % 24 + 1) <= TIMESTAMP '2024-01-30 12:00:00' AS due FROM events GROUP BY 1")
def schedule_due(t):
    """Users are schedules of 1 to 24 hours, last run at their last event."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", records.due(F.col("last"), (F.col("user_id") % 24 + 1).cast("int"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).alias("due"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'full' WHEN c_nationkey % 3 <> 0 THEN 'enrichment_only' ELSE 'none' END AS drift FROM customer")
def config_drift(t):
    """A customer's segment and nation mod 3 against BUILDING and 0; the latter is an enrichment setting."""
    now = F.to_json(F.struct(F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 3).alias("enrich")))
    return t.customer.select("c_custkey", records.drift(F.lit('{"enrich": 0, "seg": "BUILDING"}'), now, ["enrich"]).alias("drift"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS all_pages, string_agg(DISTINCT day(o_orderdate), ',' ORDER BY day(o_orderdate)) FILTER (WHERE o_orderstatus <> 'P') AS pages FROM orders GROUP BY 1")
def needed_pages(t):
    """Orders are items on the page of their day; those of status P have no pages."""
    items = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.array(F.dayofmonth("o_orderdate"))).otherwise(F.array().cast("array<int>")).alias("pages"))
    return records.needed_pages(items, "o_custkey", "pages").select("o_custkey", "all_pages", F.nullif(F.array_join("pages", ","), F.lit("")).alias("pages"))


@query("""SELECT event_id, '{"k":' || (props->>'$.k') || '}' AS moved, '{}' AS rest FROM events""")
def json_move_keys(t):
    return t.events.select("event_id", F.to_json(json.only(F.col("props"), ["k"])).alias("moved"), F.to_json(json.without(F.col("props"), ["k"])).alias("rest"))


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, CASE lower(event_type) WHEN 'view' THEN 'View' WHEN 'error' THEN 'ERROR' END AS kind FROM events")
def enrich_validate(t):
    return t.events.select("event_id", json.coerced(json.field(F.col("props"), "k"), "number").alias("k"), json.coerced(F.col("event_type"), "enum", ["View", "ERROR"]).alias("kind"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 10 MINUTE THEN 'failed' WHEN o_orderstatus = 'O' THEN 'indexing' ELSE 'indexed' END AS status FROM orders")
def stale_runs(t):
    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "indexing").otherwise("indexed").alias("status"), "o_orderdate")
    return state.timed_out(runs, "o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("id", "status")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_donut(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS items, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def enrichment_error_counts(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("items"), F.count("quality").alias("labelled"))


@query("SELECT doc_id, source, n_chars, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY n_chars DESC, doc_id LIMIT 50")
def indexed_source_list(t):
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels.where("quality = 1").select("doc_id", "toxic"), "doc_id")
    return rows.orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT doc_id, 'Document: ' || lang || ' | Section: ' || source || ' | Pages: 1-' || (2 + doc_id % 5) AS note FROM documents")
def annotation(t):
    pages = F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 5 + 2)
    return t.documents.select("doc_id", text.annotation(F.col("source"), pages, F.col("lang")).alias("note"))


@query("SELECT conv_id, 'what now what now ' || string_agg(left(text, 500), ' ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY 1")
def query_context(t):
    """The query twice, then the last six messages, each to 500 characters."""
    return sessions.query_context(t.conversations, "conv_id", "turn", F.lit("what now"), 2.0)


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) AS scheme, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  replace(trim(regexp_replace(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*(?:["''][^"''#]+|[^\s"''>#]+)', 0)), '(?is)^.*?href\s*=\s*["'']?', '')), '&amp;', '&') AS href FROM pages),
w AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN host = '' THEN NULL WHEN starts_with(href, '//') THEN scheme || href
  WHEN starts_with(href, '/') THEN scheme || '//' || host || href
  WHEN starts_with(href, '?') THEN scheme || '//' || host || CASE WHEN path = '' THEN '/' ELSE path END || href
  ELSE scheme || '//' || host || '/' || ltrim(regexp_replace(path, '[^/]*$', ''), '/') || href END AS u FROM h),
n AS (SELECT page_id, regexp_replace(u, '([^/:])/+(\?|$)', '\1\2') AS n FROM w)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(n, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+$') THEN n || '/' ELSE n END AS link FROM n WHERE regexp_matches(n, '^(?i:https?)://[^/]')""")
def link_extract(t):
    return links(t.pages).select("page_id", "link")


@query(f"WITH {_BM25} SELECT t AS term, df FROM df")
def doc_freqs(t):
    terms = _terms(t)
    hits = documents_index(t).postings.where(F.col("bucket").isin(sorted({sparse.bucket_of(x) for x in terms})) & F.col("term").isin(terms))
    return hits.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_BM25} SELECT doc_id AS item, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def sparse_index_search(t):
    return sparse.search(documents_index(t), _terms(t), 10)


_KB_BM25 = _BM25.replace("count(*) AS n, avg(len(w)) AS a FROM tok", "lang, count(*) AS n, avg(len(w)) AS a FROM tok GROUP BY 1").replace("SELECT doc_id, dl, t, count(*) AS f FROM (SELECT doc_id, len(w)", "SELECT doc_id, lang, dl, t, count(*) AS f FROM (SELECT doc_id, lang, len(w)").replace("SELECT t, count(*) AS df FROM tf GROUP BY 1", "SELECT lang, t, count(*) AS df FROM tf GROUP BY 1, 2").replace("FROM tf JOIN df USING (t), st GROUP BY 1", "FROM tf JOIN df USING (t, lang) JOIN st USING (lang) GROUP BY 1")


@query(f"WITH {_KB_BM25} SELECT doc_id, lang, score FROM bm JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def multi_kb_merge(t):
    """Languages are knowledge bases, each with statistics of its own; their lists merge by raw score."""
    best = retrieval.top(sparse.scores(documents_index(t), _terms(t), by_kb=True), "item", 10)
    return best.select(F.col("item").alias("doc_id"), F.col("kb").alias("lang"), "score")


# -- runs ------------------------------------------------------------------------------

_SPOKEN = "m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant'))"


def _dialogues(t):
    """Pairs of messages as runs: the question is the input array, the answer the content of even runs and the output array of odd ones; a multiple of 3 is not completed."""
    pair = sessions.pairs(t.conversations, "conv_id", "turn")
    one = lambda role, c: F.to_json(F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))))
    there = F.col("answer").isNotNull()
    return pair.select("conv_id", "pair", one("user", "question").alias("input_messages"), F.when(there, one("assistant", "answer")).alias("output_messages"), F.when(F.col("pair") % 2 == 0, F.col("answer")).alias("content"), F.when(F.col("pair") % 3 == 0, "failed").otherwise("completed").alias("status"))


@query(f"WITH {_SPOKEN} SELECT conv_id, CAST(p // 2 AS BIGINT) AS pair, CAST(p % 2 AS INTEGER) AS position, CASE p % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, text AS content FROM m")
def chat_messages(t):
    return runs.chat_messages(_dialogues(t), ["conv_id", "pair"])


@query(rf"WITH {_SPOKEN} SELECT conv_id, CAST(p // 2 AS BIGINT) AS pair, CAST(p % 2 AS INTEGER) AS position, CASE p % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, trim(regexp_replace(text, '\s*\[\d+\]', '', 'g')) AS content FROM m WHERE (p // 2) % 3 <> 0")
def model_history(t):
    return runs.model_history(_dialogues(t), ["conv_id", "pair"])


@query("SELECT o_orderkey, (SELECT string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS calls, (SELECT string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS cited FROM orders")
def run_hydration(t):
    """Orders are runs, their lines the calls; suppliers of returned lines are cited."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    calls = lines.select("o_orderkey", F.col("l_linenumber").alias("order"), F.col("l_partkey").alias("value"))
    cited = lines.where("l_returnflag = 'R'").select("o_orderkey", F.col("l_suppkey").alias("order"), F.col("l_suppkey").alias("value")).distinct()
    rows = runs.hydrated(t.orders.select("o_orderkey"), "o_orderkey", calls=calls, cited=cited)
    shown = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return rows.select("o_orderkey", shown("calls"), shown("cited"))


@query("""SELECT r_regionkey, r_name, CASE WHEN call IS NOT NULL THEN row_number() OVER (PARTITION BY r_regionkey ORDER BY nation, call) END AS place, nation, call
FROM region LEFT JOIN (SELECT n_regionkey AS r_regionkey, n_nationkey AS nation, s_suppkey AS call FROM nation JOIN supplier ON s_nationkey = n_nationkey) USING (r_regionkey)""")
def parent_call_rollup(t):
    """Regions are parent runs, nations their child runs, suppliers the calls of a child: a row a call, in order over all children of a parent."""
    own = t.nation.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("nation"))
    calls = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("call")).join(own, "nation")
    return runs.placed(t.region.select("r_regionkey", "r_name"), "r_regionkey", calls, ["nation", "call"]).select("r_regionkey", "r_name", "place", "nation", "call")


@query("SELECT conv_id, count(*) AS run_count, min_by(text, turn) FILTER (WHERE text <> '') AS first_message, max(turn) AS last_activity FROM conversations WHERE role = 'user' GROUP BY 1")
def session_overview(t):
    return runs.overview(t.conversations.where("role = 'user'"), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant' AND text <> '') AS summary FROM conversations GROUP BY 1")
def reasoning_summary(t):
    """What the assistant says are the reasoning events of a conversation."""
    kind = F.when(F.col("role") == "assistant", "reasoning").otherwise("other")
    events = F.array_sort(F.collect_list(F.struct("turn", kind.alias("type"), F.col("text").alias("content"))))
    return t.conversations.groupBy("conv_id").agg(events.alias("events")).select("conv_id", runs.reasoning_summary(F.col("events")).alias("summary"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O') AS final, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'O') AS last_output FROM orders GROUP BY 1")
def final_output(t):
    """Orders are a customer's blocks; urgent ones respond, open ones have no output."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "response").otherwise("agent")
    blocks = t.orders.select("o_custkey", "o_orderkey", kind.alias("type"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("output"))
    return runs.final_output(blocks, "o_custkey", "o_orderkey")


@query(f"WITH {_SPOKEN} SELECT conv_id, p AS position, epoch_us(TIMESTAMP '{NOW}' + INTERVAL 1 MICROSECOND * p) AS at_us FROM m")
def message_times(t):
    rows = sessions.numbered(t.conversations, "conv_id", "turn")
    at = runs.staggered(F.lit(NOW).cast("timestamp"), F.col("position"))
    return rows.select("conv_id", "position", F.unix_micros(at).alias("at_us"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '[... full text in storage]' ELSE text END AS text FROM documents")
def light_context(t):
    """Even documents are stored whole elsewhere."""
    kind, path = F.when(F.col("doc_id") % 2 == 0, "full_document").otherwise("chunk"), F.concat(F.lit("kb/"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", runs.light_text(kind, path, F.col("text")).alias("text"))


@query("SELECT b.item_id AS position, CASE WHEN b.item_id % 3 = 2 THEN NULL ELSE b.text END AS text FROM benchmark b WHERE b.item_id % 3 = 0 UNION ALL SELECT b.item_id, d.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 40 WHERE b.item_id % 3 = 1")
def resolved_items(t):
    """Benchmark items ask: every third by its own text, the next for the document of 40 times its id, the last for nothing."""
    n = F.col("item_id")
    asked = t.benchmark.select(n.alias("position"), F.when(n % 3 == 1, n * 40).alias("item"), F.when(n % 3 == 0, F.col("text")).alias("text"))
    return runs.resolved_items(asked, t.documents.select(F.col("doc_id").alias("item"), "text")).select("position", "text")


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS c_nationkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def partial_update(t):
    """Suppliers are updates of the customers of the same number; a negative balance is not given."""
    new = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("c_acctbal"))
    return runs.patched(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), new, "c_custkey")


@query("SELECT c_nationkey AS parent, c_custkey AS child FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal < 0")
def replace_children(t):
    """Customers are a nation's children; suppliers in debt replace them."""
    old = t.customer.select(F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("child"))
    return runs.replaced(old, t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("parent"), F.col("s_suppkey").alias("child")), "parent")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'indexed' ELSE 'stale' END WHEN o_orderstatus = 'O' THEN 'enriching' ELSE 'done' END AS status FROM orders")
def reenrich_complete(t):
    """Open orders are being enriched, those of even customers by us; every third has no earlier status."""
    open_ = F.col("o_orderstatus") == "O"
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(open_, "enriching").otherwise("done").alias("status"), F.when(F.col("o_custkey") % 2 == 0, "me").otherwise("other").alias("owner"), F.when(F.col("o_orderkey") % 3 != 0, "stale").alias("prior"))
    return runs.restored(rows, "me").select("id", "status")


# -- look-ups and listings ----------------------------------------------------------------


@query("SELECT doc_id, n_chars, count(*) OVER () AS total_count FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def page_with_total(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return listings.page_with_total(rows, [F.desc("n_chars"), "doc_id"], 50, 50)


@query("SELECT event_id, user_id, coalesce(s_name, '') AS source_name FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def cited_sources(t):
    """Events cite the supplier of the user's number; unknown ones have an empty name."""
    names = t.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("source_name"))
    return listings.filled(t.events.select("event_id", "user_id"), names, "user_id", ["source_name"]).fillna("", ["source_name"])


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN 'own' END, s_name, 'user ' || user_id) AS agent FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def session_identity(t):
    """Views name their agent, others get the supplier's name, else the user's number."""
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "view", "own").alias("agent"))
    found = listings.filled(rows, t.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("agent")), "user_id", ["agent"])
    return found.select("event_id", F.coalesce("agent", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("agent"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS title, r_name AS doc_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def node_backfill(t):
    """Nations are nodes; odd ones lack a title and take the region's."""
    nodes = t.nation.select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("title"))
    toc = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("title"), F.col("r_name").alias("doc_name"))
    return listings.filled(nodes, toc, "n_regionkey", ["title", "doc_name"]).drop("n_regionkey")


@query(f"WITH {_NODES} SELECT p.node_id AS node, c.node_id AS child FROM n p JOIN n c ON c.parent_id = p.node_id")
def node_children(t):
    nodes = _nodes(t).select(F.lit(0).alias("tree"), F.col("node_id").alias("node"), "parent_id")
    return listings.children_of(nodes, "tree", "node", "parent_id").drop("tree")


@query("""SELECT n_nationkey, n_name, count(s_suppkey) OVER (PARTITION BY n_nationkey) AS sources, CASE WHEN s_suppkey IS NOT NULL THEN row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) END AS place, s_name AS source
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def agent_kb_overview(t):
    """Nations are knowledge bases, their suppliers the indexed sources: a row a source, with the number of them."""
    held = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.col("s_name").alias("source"))
    counts = held.groupBy("n_nationkey").agg(F.count("*").alias("sources"))
    rows = runs.placed(t.nation.select("n_nationkey", "n_name").join(counts, "n_nationkey", "left"), "n_nationkey", held, ["s_suppkey"])
    return rows.select("n_nationkey", "n_name", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"), "place", "source")


@query("SELECT n_nationkey, (SELECT max(o_orderdate) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS last_activity FROM nation")
def orchestration_activity(t):
    """Orders are summed by customer before they meet the customers."""
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    by = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(last, "c_custkey").groupBy("n_nationkey").agg(F.max("at").alias("last_activity"))
    return t.nation.select("n_nationkey").join(by, "n_nationkey", "left")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 99 ELSE c_nationkey END AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def usage_backfill(t):
    """Finished orders hold a nation already; the customer's fills the rest."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.lit(99)).alias("nation"))
    return listings.filled(rows, t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey", ["nation"]).drop("o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 1), (3, 2), (5, 9))")
def pair_lookup(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return listings.in_pairs(rows, ["l_orderkey", "l_linenumber"], [1, 2, 3, 5], [1, 1, 2, 9])


@query("SELECT n_nationkey AS s_nationkey, CAST(n_nationkey * 2 + 1 AS BIGINT) AS s_suppkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n_nationkey AND s.s_suppkey = n_nationkey * 2 + 1)")
def kb_violations(t):
    """Each nation asks for the supplier of twice its number and one, which must be its own."""
    n = F.col("n_nationkey")
    return listings.unknown_pairs(t.nation.select(n.alias("s_nationkey"), (n * 2 + 1).cast("long").alias("s_suppkey")), t.supplier, ["s_nationkey", "s_suppkey"])


@query("SELECT lang, count(*) AS retrieved, count(*) FILTER (WHERE n_chars <= 1000) AS included, count(*) FILTER (WHERE n_chars > 1000) AS dropped, CAST(coalesce(sum(length(text) // 4) FILTER (WHERE n_chars <= 1000), 0) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def retrieval_figures(t):
    return listings.retrieval_figures(t.documents, "lang", "text", F.coalesce(F.col("n_chars") <= 1000, F.lit(False)))


@query("SELECT doc_id, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id LIMIT 25 OFFSET 10")
def chunk_inspector(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.asc_nulls_last("quality"), "doc_id").offset(10).limit(25)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND props->>'$.k' = '7' ORDER BY event_id LIMIT 1")
def webhook_lookup(t):
    rows = t.events.where((F.col("event_type") == "view") & json.matches(F.col("props"), {"k": 7}))
    return rows.select("event_id", "user_id").orderBy("event_id").limit(1)


@query("SELECT doc_id, source, 'document' AS kind FROM documents WHERE source IN ('src0', 'src3') UNION ALL SELECT vec_id, 'src' || label, 'vector' FROM embeddings WHERE label IN (0, 3)")
def items_by_source(t):
    """Documents and vectors are the items of two strategies, each from a table of its own."""
    docs = t.documents.where(F.col("source").isin("src0", "src3")).select("doc_id", "source", F.lit("document").alias("kind"))
    vectors_ = t.embeddings.where(F.col("label").isin(0, 3)).select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"), F.lit("vector").alias("kind"))
    return docs.unionByName(vectors_)


@query("SELECT doc_id, source AS source_name, CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'label ' || quality END AS summary FROM documents LEFT JOIN labels USING (doc_id)")
def source_backfill(t):
    """Labels are summaries of the documents; even labelled documents have one of their own."""
    marked = t.labels.select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("summary"))
    own = t.documents.select("doc_id", F.col("source").alias("source_name"))
    kept = own.join(t.labels.select("doc_id", F.lit(1).alias("_l")), "doc_id", "left").withColumn("summary", F.when((F.col("doc_id") % 2 == 0) & F.col("_l").isNotNull(), "kept")).drop("_l")
    return listings.filled(kept, marked, "doc_id", ["summary"])


@query("""SELECT doc_id, CASE WHEN toxic = 0 THEN '{"quality":' || quality || '}' END AS vals, CASE WHEN toxic = 1 THEN 'toxic' END AS error FROM labels""")
def enrichment_results(t):
    """Labels are enrichments; those of toxic documents failed."""
    good = F.col("toxic") == 0
    return t.labels.select("doc_id", F.when(good, json.packed(quality=F.col("quality"))).alias("vals"), F.when(F.col("toxic") == 1, "toxic").alias("error"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1 HAVING count(*) BETWEEN 60 AND 80")
def sessions_by_size(t):
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    return rows.where(F.col("n").between(60, 80))


@query("SELECT count(*) AS sessions FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) BETWEEN 60 AND 80)")
def sessions_counted(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n").between(60, 80)).agg(F.count("*").alias("sessions"))


@query("SELECT l_returnflag, round(avg(n), 6) AS avg_calls FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def avg_calls(t):
    """The mean length of arrays: lines of an order by flag."""
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return per.groupBy("l_returnflag").agg(F.round(F.avg("n"), 6).alias("avg_calls"))


@query("SELECT vec_id, label, round(greatest(0, 1 - 0.02 * label - 0.05 * (vec_id % 7))::DOUBLE, 6) AS score FROM (SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 40) ORDER BY score DESC, vec_id LIMIT 10")
def tree_selection(t):
    """Forty nodes of the last labels are a model's choice; the label ranks documents, the id mod 7 nodes."""
    chosen = t.embeddings.select("vec_id", "label").orderBy(F.desc("label"), "vec_id").limit(40).select("vec_id", F.col("label").alias("document_rank"), (F.col("vec_id") % 7).alias("rank"))
    return listings.selected_nodes(chosen, t.embeddings.select("vec_id", "label"), "vec_id", 10).select("vec_id", "label", "score")


_POOL = "SELECT doc_id, lang, text, round(n_chars / 20000.0, 6)::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT 40"


def _pool(t):
    """The forty longest documents, scored by length, are a result list."""
    return t.documents.select("doc_id", "lang", "text", F.round(F.col("n_chars") / 20000, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)


@query(f"SELECT doc_id, score FROM ({_POOL}) ORDER BY CASE WHEN lang <> 'en' THEN doc_id % 5 END DESC NULLS LAST, score DESC, doc_id LIMIT 10")
def rerank(t):
    """A scorer that knows no English."""
    scorer = lambda rows: rows.where("lang <> 'en'").select("doc_id", (F.col("doc_id") % 5).alias("new_score"))
    return listings.reranked(_pool(t), "doc_id", 10, scorer).select("doc_id", "score")


@query(f"SELECT lang, max(score) AS best, '## ' || lang || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY score DESC, doc_id) AS context FROM ({_POOL}) GROUP BY lang")
def context_text(t):
    return listings.context_text(_pool(t), "lang", "doc_id", F.concat(F.lit("## "), F.col("lang")), "text")


# -- sinks --------------------------------------------------------------------------------


@query("SELECT conv_id, turn, left(text, 500) AS args_preview, left(r, 500) AS result_preview, CASE WHEN starts_with(r, 'Error') THEN 'error' ELSE 'success' END AS status, CASE WHEN starts_with(r, 'Error') THEN left(r, 1000) END AS error FROM (SELECT *, CASE WHEN role = 'assistant' THEN 'Error: ' || text ELSE 'Fine: ' || text END AS r FROM conversations)")
def call_ledger(t):
    """Messages are calls; the assistant's fail."""
    result = F.concat(F.when(F.col("role") == "assistant", "Error: ").otherwise("Fine: "), F.col("text"))
    return sinks.call_ledger(t.conversations.select("conv_id", "turn", "role", "text"), F.col("text"), result).drop("role", "text")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2")
def insert_absent(t):
    """Events are citations by user and type; those of a supplier's number are there already."""
    rows = t.events.select("user_id", "event_type", "event_id")
    old = rows.join(t.supplier.select(F.col("s_suppkey").alias("user_id")), "user_id", "left_semi").select("user_id", "event_type").distinct()
    return sinks.inserted_absent(old, rows, ["user_id", "event_type"], "event_id")


@query("SELECT vec_id AS item_id, 'a' AS model, CASE WHEN vec_id % 2 = 1 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id, 'b', label + 100 FROM embeddings WHERE vec_id % 2 = 1")
def vector_upsert(t):
    """Every vector is stored for model a; odd ones come again, for both models."""
    rows = t.embeddings.select(F.col("vec_id").alias("item_id"), F.lit("a").alias("model"), "label")
    odd = rows.where("item_id % 2 = 1").withColumn("label", F.col("label") + 100)
    return sinks.upserted_vectors(rows, odd.unionByName(odd.withColumn("model", F.lit("b"))))


@query("SELECT doc_id AS item_id, 'kb' AS knowledge_base_id, source AS source_id, CAST(length(text) AS INTEGER) AS n_chars, 'store/' || source || '/' || doc_id || '.txt' AS full_text_path FROM documents")
def document_store(t):
    return sinks.document_rows(t.documents.select(F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), "text"), "kb", "store")[0]


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 25, 'ATLANTIS', NULL")
def structured_write(t):
    """An insert, an update and a delete on the nations."""
    rows = sinks.written(t.nation, "insert", {"n_nationkey": 25, "n_name": "ATLANTIS"})
    rows = sinks.written(rows, "update", {"n_regionkey": 9}, {"n_regionkey": 2})
    return sinks.written(rows, "delete", where={"n_nationkey": 3})


# more of the catalogue registers itself
from fathom.plans import rules, search, stores  # noqa: E402, F401
