"""Queries of sources and stores: url lists, types of uploads, derivatives, inspectors and what is written for items."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import listings
from fathom.plans.registry import query
from fathom.sources import sinks, tables

_URL = r"regexp_replace(regexp_replace(url, '#.*$', ''), '([^/:])/+(\?|$)', '\1\2')"


@query(rf"SELECT page_id, CASE WHEN regexp_matches(n, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+$') THEN n || '/' ELSE n END AS link, coalesce(regexp_matches(url, '^(?i:https?)://[^/?#\s]+'), false) AS valid FROM (SELECT *, {_URL} AS n FROM pages)")
def url_normalized(t):
    return t.pages.select("page_id", tables.normalized_url(F.col("url")).alias("link"), tables.valid_url(F.col("url")).alias("valid"))


@query(rf"WITH n AS (SELECT min(page_id) AS first_at, CASE WHEN regexp_matches({_URL}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+$') THEN {_URL} || '/' ELSE {_URL} END AS url FROM pages WHERE regexp_matches(url, '^(?i:https?)://[^/?#\s]+') GROUP BY 2 ORDER BY 1, 2 LIMIT 100) SELECT url, CAST(row_number() OVER (ORDER BY first_at, url) - 1 AS INTEGER) AS position FROM n")
def url_list(t):
    """At most a hundred pages to import, each once."""
    return tables.url_list(t.pages, "url", "page_id", 100)


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'text/markdown' ELSE 'image/jpeg' END AS mime FROM pages")
def upload_types(t):
    """Uploads that are declared vaguely, well, vaguely with an unknown extension, not at all and by case."""
    n = F.col("page_id") % 5
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".pdf", ".xyz", ".md", ".JPG"))), (n + 1).cast("int")))
    declared = F.when(n == 1, "text/html").when(n.isin(0, 2), "application/octet-stream").when(n == 4, "")
    return t.pages.select("page_id", tables.mime_type(name, declared).alias("mime"))


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 1 THEN 'markdown' WHEN doc_id % 3 = 2 THEN 'html' ELSE 'text' END AS kind, length(text) AS n FROM documents WHERE text IS NOT NULL")
def extraction_dispatch(t):
    """Documents as files of three types, one of them unknown."""
    mime = F.when(F.col("doc_id") % 3 == 1, "text/markdown").when(F.col("doc_id") % 3 == 2, "text/html").otherwise("application/x-unknown")
    rows = tables.derivatives(t.documents.select(F.col("doc_id").alias("source_id"), mime.alias("mime"), "text"))
    return rows.select("source_id", "kind", F.length("text").cast("long").alias("n"))


@query()
def page_files(t):
    """Pages as uploaded files: the text that each shows, by the extractor of their type. No SQL: HTML is read by a parser."""
    raw = t.pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.length("html").cast("long").alias("length"), F.encode("html", "UTF-8").alias("content"))
    return tables.extracted_files(raw).select("path", "kind", "text", "error")


@query("SELECT doc_id AS source_id, CAST(i AS INTEGER) AS page, string_split(text, chr(10))[i] AS text FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
def page_texts(t):
    """A line of a document is one of its pages."""
    return tables.page_texts(t.documents.select(F.col("doc_id").alias("source_id"), F.split("text", "\n", -1).alias("pages")))


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'text' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE left(text, 10) END AS text FROM documents WHERE text IS NOT NULL")
def text_derivative(t):
    """Documents have a text and an image, even ones markdown too."""
    rows = t.documents.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("source_id"), "text")
    kind = lambda name, body, some=F.lit(True): rows.where(some).select("source_id", F.lit(name).alias("kind"), body.alias("text"))
    derived = kind("text", F.left("text", F.lit(10))).unionByName(kind("image", F.lit("png"))).unionByName(kind("markdown", F.lit("md"), F.col("source_id") % 2 == 0))
    return tables.indexed_text(derived)


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^<&]+$')")
def sitemap(t):
    """The pages' urls, in one map a page below an index of indexes."""
    plain = t.pages.where(F.col("url").rlike("^https?://[^<&]+$"))
    leaf = F.concat(F.lit("map-"), F.col("page_id").cast("string"))
    loc = lambda u: F.concat(F.lit("<loc> "), u, F.lit("\n</loc>"))
    leaves = plain.select(leaf.alias("loc"), F.concat(F.lit("<urlset><url>"), loc(F.col("url")), F.lit("</url></urlset>")).alias("xml"), "page_id")
    inner = leaves.select(F.concat(F.lit("index-"), (F.col("page_id") % 4).cast("string")).alias("loc"), F.concat(F.lit("<sitemapindex>"), loc(F.col("loc")), loc(F.lit("root")), F.lit("</sitemapindex>")).alias("xml"))
    root = inner.select("loc").distinct().select(F.lit("root").alias("at"), F.concat(F.lit("<sitemapindex>"), loc(F.col("loc")), F.lit("</sitemapindex>")).alias("xml")).withColumnRenamed("at", "loc")
    found = tables.sitemap_pages(leaves.drop("page_id").unionByName(inner).unionByName(root), "root", 3)
    return plain.select("page_id", "url").join(found, "url").select("page_id", "url")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def row_browse(t):
    return tables.browse(t.customer.select("c_custkey", "c_name"), "c_custkey", 20, 40)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 17")
def row_by_id(t):
    return tables.row_by_id(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey", 17)


# -- stores -----------------------------------------------------------------------------


@query("SELECT vec_id AS item_id, 'kb' AS knowledge_base_id, 'm' AS model, len(embedding) AS dims FROM embeddings WHERE vec_id % 10 <> 0")
def chunk_store(t):
    """Every tenth chunk has no vector yet."""
    chunks = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("label").alias("source_id"), F.lit(0).alias("chunk_index"), F.lit("t").alias("text"), F.when(F.col("vec_id") % 10 != 0, F.col("embedding")).alias("embedding"))
    return sinks.chunk_rows(chunks, "kb", "m")[1].select("item_id", "knowledge_base_id", "model", F.col("dims").cast("long").alias("dims"))


@query("SELECT n_regionkey AS source_id, 'kb' AS knowledge_base_id, count(*) AS n_nodes, max(n_nationkey % 3) AS depth FROM nation GROUP BY 1")
def tree_store(t):
    """A region is a tree of its nations, their depth the id mod 3."""
    nodes = t.nation.select(F.col("n_regionkey").alias("source_id"), F.col("n_nationkey").alias("node_id"), F.lit(None).cast("int").alias("parent_id"), (F.col("n_nationkey") % 3).alias("depth"), F.col("n_name").alias("title"), F.lit("").alias("text"))
    return sinks.tree_rows(nodes, "kb")[0]


@query("SELECT event_id AS item_id, 'kb' AS knowledge_base_id, user_id AS source_id, props AS document, length(props) // 4 AS token_count, CAST(greatest(1, ceil((length(props) - 200) / 3800)) AS BIGINT) AS window_count FROM events WHERE json_valid(props)")
def json_store(t):
    """Events' properties are documents extracted as JSON."""
    rows = t.events.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("source_id"), F.col("props").alias("document"))
    return sinks.json_rows(rows, "kb")


@query("SELECT s_suppkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS bases FROM supplier JOIN nation ON n_nationkey = s_nationkey OR n_nationkey = s_suppkey % 25 GROUP BY 1")
def source_dependencies(t):
    """A supplier is a source of its nation and of the nation of its number."""
    own = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    other = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 25).cast("int").alias("n_nationkey"))
    found = listings.dependencies(own.unionByName(other), t.nation, "s_suppkey", "n_nationkey", "n_name")
    return found.select("s_suppkey", F.array_join("bases", ",").alias("bases"))


@query("SELECT n_nationkey AS node_id, n_name AS title, r_name AS toc FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey IN (1, 2) ORDER BY n_regionkey, n_nationkey LIMIT 8 OFFSET 1")
def node_inspector(t):
    """Nodes of two trees with the tree's name, a page of them in order."""
    nodes = t.nation.select(F.col("n_regionkey").alias("toc_id"), F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("title"))
    return listings.nodes_of(nodes, t.region.select(F.col("r_regionkey").alias("toc_id"), F.col("r_name").alias("toc")), [1, 2], 8, 1).select("node_id", "title", "toc")


@query("SELECT doc_id, source, left(text, 200) AS preview, length(text) AS n FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 10")
def document_inspector(t):
    rows = t.documents.where("source = 'src1'").orderBy("doc_id").limit(10)
    return rows.select("doc_id", "source", F.left("text", F.lit(200)).alias("preview"), F.length("text").cast("long").alias("n"))
