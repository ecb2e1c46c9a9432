"""Sources: tables of a folder, wholetext files, catalog listing, URL and MIME helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import office
from fathom.session import ship


class Tables:
    """Lazy Parquet tables of a folder: Tables(spark, dir).documents. Columns and filters reach the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


#: MIME types by extension, for uploads that arrive as octet streams.
MIME_TYPES = {
    "pdf": "application/pdf",
    "txt": "text/plain",
    "md": "text/markdown",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "gif": "image/gif",
    "tiff": "image/tiff",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def mime_type(name: Column, declared: Column) -> Column:
    """The declared type; for octet streams and none, the extension's."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    vague = declared.isNull() | (declared == "") | (declared == "application/octet-stream")
    return F.when(vague, F.coalesce(F.try_element_at(known, extension(name)), declared, F.lit("application/octet-stream"))).otherwise(declared)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Allowed files under a path: path, length, mime, text (text types only)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mime = mime_type(F.col("path"), F.lit(None).cast("string"))
    allowed = raw.where(extension(F.col("path")).isin(*MIME_TYPES)).withColumn("mime", mime)
    return allowed.select("path", "length", "mime", F.when(F.col("mime").startswith("text/"), F.decode("content", "UTF-8")).alias("text"))


FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files that arrive under a path, as a stream: each once, in order of modification, a bounded number a trigger."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return raw.load(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path, dealt to tasks by their bytes; files without any are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def extracted_files(raw: DataFrame) -> DataFrame:
    """Files (path, modificationTime, length, content), of a batch or a stream, of allowed types: path, length, modified, mime, kind, text, error.

    docx as markdown, xlsx, pptx, HTML and text types as text; a file that can't be read has an error and no text, and takes no other with it.
    """
    ship(raw.sparkSession)
    if raw.sparkSession.conf.get(_ROWS) == "10000":  # the default: a batch of whole files is held several times over
        raw.sparkSession.conf.set(_ROWS, "500")

    @F.pandas_udf("struct<kind: string, text: string, error: string>")
    def read(mime: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([office.extracted(m, c) for m, c in zip(mime, content)], columns=["kind", "text", "error"])

    allowed = raw.where(extension(F.col("path")).isin(*MIME_TYPES, "html", "htm"))
    mime = F.when(extension(F.col("path")).isin("html", "htm"), "text/html").otherwise(mime_type(F.col("path"), F.lit(None).cast("string")))
    told = allowed.withColumn("mime", mime).withColumn("_x", read("mime", "content"))
    return told.select("path", "length", F.col("modificationTime").alias("modified"), "mime", "_x.kind", "_x.text", "_x.error")


def markdown_docs(spark: SparkSession, root: str, prefix: str, largest: int = 1_000_000) -> DataFrame:
    """Markdown files under root: key `prefix:relative path`, content, its hash and title; empty and oversized ones are skipped."""
    from fathom.functions.text import document_title

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").load(root)
    text = F.decode("content", "UTF-8")
    base = F.regexp_replace(F.lit(root), r"/+$", "")
    rel = F.expr("substring(path, locate(base, path) + length(base) + 1)")
    rows = raw.where((F.col("length") > 0) & (F.col("length") <= largest)).withColumn("base", base)
    rows = rows.select(F.concat(F.lit(prefix + ":"), rel).alias("key"), text.alias("content")).where(F.trim("content") != "")
    return rows.withColumn("content_hash", F.sha2("content", 256)).withColumn("title", document_title(F.col("content"), F.col("key"))).orderBy("key")


def normalized_url(url: Column) -> Column:
    """Without fragment and trailing slashes; an empty path becomes /."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"(?<![/:])/+(?=$|\?)", "")
    return F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+$"), F.concat(bare, F.lit("/"))).otherwise(bare)


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port and brackets."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(found, r"[\[\]]", ""))


#: Hosts that stand for this machine or its network, as far as a name or literal address tells: loopback, private, link-local, unspecified.
_PRIVATE = r"^(?:localhost|.*\.localhost|0\.0\.0\.0|127(?:\.\d{1,3}){3}|10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|169\.254(?:\.\d{1,3}){2}|::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"


def valid_url(url: Column) -> Column:
    """http or https with a host that is no private address; what a name resolves to is not looked up."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+") & (url_host(url) != "") & ~url_host(url).rlike(_PRIVATE), F.lit(False))


def url_list(urls: DataFrame, url: str, order: str, most: int) -> DataFrame:
    """(url, position): valid urls, normalized, the first of each by `order`, at most `most`, numbered from 0."""
    rows = urls.where(valid_url(F.col(url))).groupBy(normalized_url(F.col(url)).alias("url")).agg(F.min(order).alias("_at"))
    kept = rows.orderBy("_at", "url").limit(most)
    return kept.select("url", (F.row_number().over(Window.orderBy("_at", "url")) - 1).alias("position"))


def absolute_url(base: Column, href: Column) -> Column:
    """href seen from the page at `base`: with a scheme of its own, //host, /path, ?query or a relative path whose dots are resolved. Null if base has no host."""
    scheme = F.nullif(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1), F.lit(""))
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"^/", ""))
    query_ = F.regexp_extract(href, r"^[^?]*(\?.*)$", 1)
    asked = F.regexp_extract(href, r"^([^?]*)", 1)
    whole = F.when(asked.startswith("/"), asked).otherwise(F.concat(folder, asked))
    steps = F.split(whole, "/", -1)
    last = F.element_at(steps, -1)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s.isin(".", ""), kept).otherwise(F.concat(kept, F.array(s))))
    tail = F.when(last.isin("", ".", "..") & (F.size(walked) > 0), "/").otherwise("")
    clean = F.concat(F.lit("/"), F.array_join(walked, "/"), tail)
    own = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(scheme.isNull(), None).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("?"), F.concat(origin, own, href)).otherwise(F.concat(origin, clean, query_))


def links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, position, link): targets of <a href>, in quotes or without, resolved against the page's url and normalized, http and https only, each once, in page order."""
    raw = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*(?:[\"'][^\"'#]+|[^\s\"'>#]+)"), F.lit(0))
    bare = lambda h: F.trim(F.regexp_replace(h, r"(?is)^.*?href\s*=\s*[\"']?", ""))
    whole = F.transform(raw, lambda h: normalized_url(absolute_url(F.col("url"), F.replace(bare(h), F.lit("&amp;"), F.lit("&")))))
    found = F.array_distinct(F.filter(whole, lambda u: u.rlike("^(?i:https?)://[^/]")))
    if most is not None:
        found = F.slice(found, 1, most)
    return pages.select("page_id", F.posexplode(found).alias("position", "link"))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """maps(xml) to (kind, url): page urls of <urlset>, child maps of <sitemapindex>."""
    kind = F.when(F.col("xml").contains("<sitemapindex"), "index").otherwise("page")
    return maps.select(kind.alias("kind"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("url")).distinct()


def sitemap_pages(maps: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """maps(loc, xml), all that was fetched: the page urls (url) that the map at `root` leads to, over at most `depth` levels of maps; loops end there."""
    kind = F.col("xml").contains("<sitemapindex")
    told = maps.select("loc", kind.alias("index"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("url"))
    level = reached = maps.where(F.col("loc") == root).select("loc")
    for _ in range(depth - 1):
        level = told.where("index").join(level, "loc", "left_semi").select(F.col("url").alias("loc"))
        reached = reached.unionByName(level)
    return told.where("not index").join(reached, "loc", "left_semi").select("url").distinct()


def catalog_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_columns(spark: SparkSession, table: str) -> list[dict]:
    return [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(table)]


def browse(table: DataFrame, order: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return table.orderBy(order).offset(offset).limit(limit)


def row_by_id(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value)).limit(1)


def imported(spark: SparkSession, pattern: str, most: int = 1_000_000_000) -> DataFrame:
    """Files of an object store by a glob: path, name, length, modified, mime; empty ones, larger ones than `most` and folders are left out, contents are not read."""
    raw = spark.read.format("binaryFile").load(pattern).where(F.col("length") <= most)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), mime_type(name, F.lit(None).cast("string")).alias("mime"))


#: Kinds of derivatives in the order in which one is taken for indexing, and their MIME types.
DERIVATIVES = {"markdown": "text/markdown", "text": "text/plain", "html": "text/html"}


def derivatives(files: DataFrame) -> DataFrame:
    """files(source_id, mime, text) to (source_id, kind, text): the extractor of a text format by its type; any other type is read as text."""
    kinds = F.create_map(*[F.lit(x) for kind, mime in DERIVATIVES.items() for x in (mime, kind)])
    return files.where(F.col("text").isNotNull()).select("source_id", F.coalesce(F.try_element_at(kinds, F.col("mime")), F.lit("text")).alias("kind"), "text")


def page_texts(files: DataFrame, page: int | None = None) -> DataFrame:
    """files(source_id, pages array<string>) to (source_id, page, text), pages from 1; one of them if asked."""
    rows = files.select("source_id", F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1)
    return rows if page is None else rows.where(F.col("page") == page)


def indexed_text(derived: DataFrame) -> DataFrame:
    """derived(source_id, kind, text) to (source_id, kind, text): the derivative to index, by the order of DERIVATIVES. Other kinds are no text."""
    order = F.create_map(*[F.lit(x) for i, kind in enumerate(DERIVATIVES) for x in (kind, i)])
    rows = derived.withColumn("_o", F.try_element_at(order, F.col("kind"))).where("_o is not null")
    best = rows.groupBy("source_id").agg(F.min(F.struct("_o", "kind", "text")).alias("_b"))
    return best.select("source_id", "_b.kind", "_b.text")
