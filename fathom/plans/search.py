"""Queries of retrieval: filters, the composed pipeline, context, the sparse index and what goes with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathom.functions import stem, text, vectors
from fathom.operators import listings, retrieval, sparse, state, structure
from fathom.operators.segments import SegmentedIndex
from fathom.plans import table_functions
from fathom.plans.indexes import documents_index, stemmed_index, vectors_index
from fathom.plans.registry import query
from fathom.session import shared_folder, ship

_VEC = "SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _asked(t):
    found = t.embeddings.where("vec_id = 0").select("embedding").first()
    return vectors.literal(found[0]) if found and found[0] else F.lit(None).cast("array<double>")


def _items(t):
    """Documents with the vector of their number and metadata of their language and source."""
    meta = F.to_json(F.struct(F.struct("lang", "source").alias("origin"), F.array(F.lit("doc"), F.col("lang")).alias("tags"), F.col("n_chars").alias("size")))
    return t.documents.select(F.col("doc_id").alias("item"), "lang", "source", meta.alias("meta"))


@query(f"SELECT d.doc_id AS item, d.source, v.score FROM documents d JOIN ({_VEC}) v ON v.vec_id = d.doc_id WHERE d.lang = 'en' AND d.source IN ('src0', 'src1', 'src2', 'src3') AND v.score >= 0.05 ORDER BY score DESC, item LIMIT 10")
def filtered_topk(t):
    """The nearest of English items of four sources above a threshold; all filters come before the cut."""
    rows = retrieval.filtered(_items(t), {"source": ["src0", "src1", "src2", "src3"]}, {"origin": {"lang": "en"}, "tags": ["en"]})
    both = retrieval.items_with_vectors(rows, t.embeddings.select(F.col("vec_id").alias("item"), "embedding"), "item", 64)
    return retrieval.top(retrieval.vector_scores(both, _asked(t)), "item", 10, 0.05).select("item", "source", "score")


@query("SELECT d.doc_id AS item, len(e.embedding) AS dims FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE len(e.embedding) = 64")
def items_with_vectors(t):
    rows = t.documents.select(F.col("doc_id").alias("item"))
    both = retrieval.items_with_vectors(rows, t.embeddings.select(F.col("vec_id").alias("item"), "embedding"), "item", 64)
    return both.select("item", F.size("embedding").cast("long").alias("dims"))


@query(f"WITH v AS ({_VEC}), c AS (SELECT * FROM v WHERE score >= 0.1), b AS (SELECT label FROM c GROUP BY 1 ORDER BY max(score) DESC, 1 LIMIT 4), p AS (SELECT c.*, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM c SEMI JOIN b USING (label)) SELECT vec_id, label, score FROM p WHERE place <= 2")
def sources_above_threshold(t):
    """The threshold comes before the cap on sources."""
    rows = retrieval.vector_scores(t.embeddings, _asked(t)).select("vec_id", "label", "score")
    return retrieval.per_source(rows, "label", "vec_id", 2, 4, threshold=0.1).select("vec_id", "label", "score")


@query(f"""WITH v AS ({_VEC}), m AS (SELECT * FROM v WHERE score >= 0.02 ORDER BY score DESC, vec_id LIMIT 40),
main AS (SELECT *, false AS source_floor FROM m),
f AS (SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM v WHERE score >= 0.02) WHERE r <= 1),
a AS (SELECT vec_id, label, score, source_floor FROM main UNION ALL SELECT vec_id, label, score, true FROM f WHERE vec_id NOT IN (SELECT vec_id FROM m)),
e AS (SELECT a.*, CASE WHEN quality IS NOT NULL THEN '{{"quality":' || quality || ',"toxic":' || toxic || '}}' END AS enrichment, CAST(a.vec_id % 7 AS DOUBLE) AS s FROM a LEFT JOIN labels ON doc_id = vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r, max(s) OVER (PARTITION BY label) AS best FROM e)
SELECT vec_id, label, s AS score, source_floor, 'vector_search' AS retrieval_method, enrichment, array_to_string(range(vec_id % 5 + 1, vec_id % 5 + vec_id % 3 + 2), ',') AS pages
FROM p WHERE r <= 3 ORDER BY r <= 1 DESC, CASE WHEN r <= 1 THEN best END DESC NULLS LAST, s DESC, vec_id LIMIT 12""")
def retrieval_pipeline(t):
    """Vector search for vector 0, labels being sources and enrichments; a scorer that knows ids mod 7; one row of each source at least, three at most."""
    start = F.col("vec_id") % 5 + 1
    meta = F.to_json(F.struct(start.alias("start_page"), (start + F.col("vec_id") % 3).alias("end_page")))
    rows = retrieval.vector_scores(t.embeddings, _asked(t)).where("score >= 0.02").select("vec_id", "label", "score", meta.alias("meta"))
    floor = retrieval.per_source(rows, "label", "vec_id", 1, None).select("vec_id", "label", "score", "meta")
    notes = retrieval.enrichment_of(t.labels.withColumnRenamed("doc_id", "vec_id"), "vec_id", ["quality", "toxic"], "completed")
    scorer = lambda r: r.select("vec_id", (F.col("vec_id") % 7).cast("double").alias("new_score"))
    found = retrieval.pipeline(retrieval.top(rows, "vec_id", 40), "vec_id", "label", 12, "vector_search", 0.02, floor, notes, scorer, most=3, least=1)
    return found.select("vec_id", "label", "score", "source_floor", "retrieval_method", "enrichment", F.array_join("pages", ",").alias("pages"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1,3' WHEN 1 THEN '2,3,4' WHEN 2 THEN '7' WHEN 3 THEN '5' ELSE '' END AS pages FROM documents")
def pages_for_item(t):
    """Metadata of five shapes: a list with repeats and words, a range, a start, a range without use of an empty list, nothing."""
    n = F.col("doc_id") % 5
    meta = F.when(n == 0, '{"pages": [3, "1", "x", 3], "start_page": 9}').when(n == 1, '{"start_page": 2, "end_page": "4"}').when(n == 2, '{"start_page": 7, "end_page": null}').when(n == 3, '{"pages": [], "start_page": 5, "end_page": 5}').otherwise(F.when(F.col("doc_id") % 2 == 0, "{}"))
    return t.documents.select("doc_id", F.array_join(structure.item_pages(meta), ",").alias("pages"))


@query("SELECT o_custkey, o_orderkey, array_to_string(list_slice(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], lambda p: o_orderkey % 4 = 0 OR p BETWEEN o_orderkey % 4 AND o_orderkey % 4 + 2), 1, 10), ',') AS images FROM orders")
def image_pages(t):
    """Each source has images of pages 1 to 12; an item of no page takes all, ten at most."""
    n = (F.col("o_orderkey") % 4).cast("int")
    pages = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(n, n + 2))
    images = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda p: F.struct(p.alias("page"), F.concat(F.lit("p"), p.cast("string")).alias("path")))
    shown = F.transform(structure.item_images(pages, images), lambda x: x["page"])
    return t.orders.select("o_custkey", "o_orderkey", F.array_join(shown, ",").alias("images"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 2 OR quality IS NOT NULL THEN CASE WHEN doc_id % 3 <> 2 THEN 'Document: ' || lang || CASE WHEN doc_id % 3 = 1 THEN chr(10) || 'Section: ' || source ELSE '' END || CASE WHEN quality IS NOT NULL THEN chr(10) ELSE '' END ELSE '' END || CASE WHEN quality IS NOT NULL THEN 'Metadata: quality: ' || quality || ', toxic: ' || toxic ELSE '' END || chr(10) || chr(10) || left(text, 100) ELSE left(text, 100) END AS shown FROM documents LEFT JOIN labels USING (doc_id)")
def rerank_text(t):
    """Every third document has no name, and every third a section."""
    n = F.col("doc_id") % 3
    packed = F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality", "toxic")))
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", text.reranker_text(F.left("text", F.lit(100)), F.when(n != 2, F.col("lang")), F.when(n == 1, F.col("source")), packed).alias("shown"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN left(n_name || ' text', 500) ELSE array_to_string(list_filter([CASE WHEN n_nationkey % 4 >= 1 THEN n_name END, CASE WHEN n_nationkey % 4 >= 2 THEN 'about ' || n_name END, CASE WHEN n_nationkey % 4 = 3 THEN 'References: ' || r_name || ', x' END], lambda x: x IS NOT NULL), chr(10)) END AS shown FROM nation JOIN region ON r_regionkey = n_regionkey")
def embed_input(t):
    """Nations are nodes with more or fewer parts; one refers to its region and to a node without title."""
    n, name = F.col("n_nationkey") % 4, F.col("n_name")
    refs = F.when(n == 3, F.array(F.col("r_name"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = t.nation.join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return rows.select("n_nationkey", text.embed_input(F.when(n >= 1, name), F.when(n >= 2, F.concat(F.lit("about "), name)), refs, F.concat(name, F.lit(" text"))).alias("shown"))


@query(r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+')) > 50 THEN array_to_string(regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+')[1:50], '') WHEN len(regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+')) = 0 THEN left(text, 100000) ELSE text END AS cut FROM documents")
def summary_input(t):
    return t.documents.select("doc_id", text.summary_input(F.col("text"), 50).alias("cut"))


_PARTS = """r AS (SELECT doc_id, source, text, round(n_chars / 20000.0, 6)::DOUBLE AS score, [doc_id % 3 + 1] AS pages FROM documents ORDER BY score DESC, doc_id LIMIT 30),
g AS (SELECT *, max(score) OVER (PARTITION BY source) AS best FROM r), o AS (SELECT *, row_number() OVER (ORDER BY best DESC, source, score DESC, doc_id) AS place FROM g),
n AS (SELECT min(place) AS place FROM o GROUP BY source, pages[1]),
p AS (SELECT o.place, doc_id, o.place NOT IN (SELECT place FROM n) AS shown_before, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY o.place) = 1 THEN '## ' || source || chr(10) ELSE '' END || '[' || o.place || ']' || CASE WHEN o.place NOT IN (SELECT place FROM n) THEN ' (content already shown above)' ELSE chr(10) || text END AS text FROM o),
x AS (SELECT *, length(text) // 4 AS tokens, sum(length(text) // 4) OVER (ORDER BY place) <= 20000 AS included FROM p)"""


def _parts(t):
    """The thirty longest documents as a result list, each on one of three pages of its source."""
    rows = t.documents.select("doc_id", "source", "text", F.round(F.col("n_chars") / 20000, 6).alias("score"), F.array((F.col("doc_id") % 3 + 1).cast("int")).alias("pages"))
    return retrieval.assembled(rows.orderBy(F.desc("score"), "doc_id").limit(30), "doc_id", "source", "text", "pages", 20_000)


@query(f"WITH {_PARTS} SELECT CAST(place AS INTEGER) AS place, doc_id, text, shown_before, CAST(tokens AS BIGINT) AS tokens, included FROM x")
def context_parts(t):
    return _parts(t)


@query(f"WITH {_PARTS} SELECT count(*) AS total, count(*) FILTER (WHERE included) AS included, count(*) FILTER (WHERE NOT included) AS dropped, count(*) FILTER (WHERE included AND shown_before) AS overlapping, CAST(coalesce(sum(tokens) FILTER (WHERE included), 0) AS BIGINT) AS tokens FROM x")
def context_figures(t):
    return retrieval.assembly_figures(_parts(t))


# -- the sparse index ------------------------------------------------------------------

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"


@query(f"SELECT lang AS kb, count(*) AS item_count, CAST(coalesce(sum(len({_W})), 0) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def index_sidecar(t):
    return documents_index(t).totals.select("kb", "item_count", "tokens")


@query(f"SELECT 'ready' AS whole, 'absent' AS missing, CASE WHEN count(*) = 0 THEN NULL ELSE 'stale' END AS behind, CAST(NULL AS VARCHAR) AS empty FROM documents HAVING count(*) > 0")
def index_readiness(t):
    """The index of the documents against their number, one more, none, and a folder without an index."""
    indexed, n = sparse.IndexRetriever(t.spark, "none"), t.documents.count()
    missing = indexed.status(n)
    indexed.index = documents_index(t)
    found = [(indexed.status(n), missing, indexed.status(n + 1), indexed.status(0))]
    return t.spark.createDataFrame(found, "whole string, missing string, behind string, empty string")


_FILTERED = rf"""tok AS (SELECT doc_id, source, {_W} AS w FROM documents), q AS (SELECT DISTINCT unnest({_W}) AS t FROM benchmark WHERE item_id = 0),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok), tf AS (SELECT doc_id, source, dl, t, count(*) AS f FROM (SELECT doc_id, source, len(w) AS dl, unnest(w) AS t FROM tok) SEMI JOIN q USING (t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1)"""


@query(f"WITH {_FILTERED} SELECT doc_id, round(sum(ln(greatest(1, (n - df + 0.5) / (df + 0.5))) * f / (f + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (t), st WHERE source IN ('src1', 'src4') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10")
def sparse_filtered(t):
    """Only two sources, by a filter before the cut; the statistics are those of all documents."""
    asked = t.benchmark.where("item_id = 0").select("text").first()
    among = t.documents.where(F.col("source").isin("src1", "src4")).select(F.col("doc_id").alias("item"))
    return sparse.search(documents_index(t), retrieval.query_terms(asked[0]) if asked and asked[0] else [], 10, among).withColumnRenamed("item", "doc_id")


@query(f"WITH {_FILTERED.split('tf AS')[0].rstrip().rstrip(',')}, d AS (SELECT w AS term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS w FROM tok) SEMI JOIN q ON q.t = w GROUP BY 1) SELECT '{{' || string_agg('\"' || term || '\":' || n, ',' ORDER BY term) || '}}' AS freqs FROM d")
def doc_freq_map(t):
    """Document frequencies of a query's terms as one object."""
    asked = t.benchmark.where("item_id = 0").select("text").first()
    terms = retrieval.query_terms(asked[0]) if asked and asked[0] else []
    hits = documents_index(t).postings.where(F.col("bucket").isin(sorted({sparse.bucket_of(x) for x in terms})) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "df"))))).alias("freqs"))  # as many entries as the query has terms


def _stems(words: str, p: str = "") -> str:
    """SQL of the stems s of the distinct words w of a table, rule after rule: a chain of common table expressions, named with p in front, that ends in `stems`."""

    def table(name: str, source: str, endings: dict[str, str], fits: str) -> str:
        end = f"regexp_extract(x, '(?:{'|'.join(endings)})$')"
        made = "CASE e " + " ".join(f"WHEN '{e}' THEN '{to}'" for e, to in endings.items()) + " END"
        cut = f"SELECT *, left(x, length(x) - length(e)) AS rest FROM (SELECT *, {end} AS e FROM {source})"
        return f"{name} AS (SELECT w, r1, r2, CASE WHEN e <> '' AND ({fits}) THEN rest || {made} ELSE x END AS x FROM ({cut}))"

    region = "'^(?s:.*?)[aeiouy][^aeiouy]'"
    short = "'([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'"
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stem.SPECIAL.items())
    listed = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    return f"""{p}y0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM {words}),
{p}y1 AS (SELECT *, regexp_extract(x, '^(?:{stem.EARLY_R1.pattern})') AS early, regexp_extract(x, {region}) AS a FROM {p}y0),
{p}y2 AS (SELECT w, x, CASE WHEN early <> '' THEN length(early) WHEN a <> '' THEN length(a) ELSE length(x) END AS r1 FROM {p}y1),
{p}y3 AS (SELECT *, regexp_extract(substr(x, r1 + 1), {region}) AS b FROM {p}y2),
{p}y4 AS (SELECT w, r1, CASE WHEN b <> '' THEN r1 + length(b) ELSE length(x) END AS r2, CASE
    WHEN x LIKE '%sses' THEN left(x, length(x) - 2)
    WHEN x LIKE '%ied' OR x LIKE '%ies' THEN left(x, length(x) - CASE WHEN length(x) > 4 THEN 2 ELSE 1 END)
    WHEN x LIKE '%s' AND NOT x LIKE '%us' AND NOT x LIKE '%ss' AND regexp_matches(x, '[aeiouy](?s:.)+s$') THEN left(x, length(x) - 1)
    ELSE x END AS x FROM {p}y3),
{p}p0 AS (SELECT *, regexp_extract(x, '(?:eedly|eed|edly|ed|ingly|ing)$') AS e FROM {p}y4),
{p}p1 AS (SELECT *, left(x, length(x) - length(e)) AS rest FROM {p}p0),
{p}p2 AS (SELECT w, r1, r2, CASE
    WHEN e = '' OR x IN ({listed(stem.INVARIANT_AFTER_1A)}) THEN x
    WHEN e LIKE 'eed%' THEN CASE WHEN length(rest) >= r1 THEN rest || 'ee' ELSE x END
    WHEN NOT regexp_matches(rest, '[aeiouy]') THEN x
    WHEN regexp_matches(rest, '(?:at|bl|iz)$') THEN rest || 'e'
    WHEN regexp_matches(rest, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(rest, length(rest) - 1)
    WHEN r1 >= length(rest) AND regexp_matches(rest, {short}) THEN rest || 'e'
    ELSE rest END AS x, x IN ({listed(stem.INVARIANT_AFTER_1A)}) AS whole, x AS after_1a FROM {p}p1),
{p}p3 AS (SELECT w, r1, r2, CASE WHEN length(x) > 2 AND regexp_matches(x, '[^aeiouy][yY]$') THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM {p}p2),
{table(f"{p}s2", f"{p}p3", stem.STEP_2, f"length(rest) >= r1 AND (e <> 'ogi' OR rest LIKE '%l') AND (e <> 'li' OR regexp_matches(rest, '[{stem.LI_ENDING}]$'))")},
{table(f"{p}s3", f"{p}s2", stem.STEP_3, "length(rest) >= CASE WHEN e = 'ative' THEN r2 ELSE r1 END")},
{table(f"{p}s4", f"{p}s3", stem.STEP_4, "length(rest) >= r2 AND (e <> 'ion' OR regexp_matches(rest, '[st]$'))")},
{p}s5 AS (SELECT w, CASE
    WHEN x LIKE '%e' AND (length(x) - 1 >= r2 OR length(x) - 1 >= r1 AND NOT regexp_matches(left(x, length(x) - 1), {short})) THEN left(x, length(x) - 1)
    WHEN x LIKE '%ll' AND length(x) - 1 >= r2 THEN left(x, length(x) - 1)
    ELSE x END AS x FROM {p}s4),
{p}stems AS (SELECT w, CASE WHEN length(w) <= 2 OR w IN ({listed(stem.INVARIANT)}) THEN w
    WHEN whole THEN replace(after_1a, 'Y', 'y')
    ELSE CASE w {special} ELSE replace(x, 'Y', 'y') END END AS s FROM {p}s5 JOIN (SELECT w, whole, after_1a FROM {p}p2) USING (w))"""


_KEPT = f"list_filter({_W}, lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}))"
_STEMMED = f"""flat AS (SELECT doc_id, unnest({_KEPT}) AS w, generate_subscripts({_KEPT}, 1) AS i FROM documents),
v AS (SELECT DISTINCT w FROM flat), {_stems('v')}"""


@query(f"WITH {_STEMMED} SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY i), CASE WHEN text IS NOT NULL THEN '' END) AS tokens FROM documents LEFT JOIN flat USING (doc_id) LEFT JOIN stems USING (w) GROUP BY doc_id, text")
def search_tokens(t):
    ship(t.spark)
    return t.documents.select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(text.search_tokens(F.col("text")), " ")).alias("tokens"))


_STEM_BM25 = f"{_STEMMED}, q0 AS (SELECT unnest({_KEPT}) AS w FROM benchmark WHERE item_id = 0), qs AS (SELECT DISTINCT w FROM q0), {_stems('qs', 'q_')}"


@query(f"""WITH {_STEM_BM25},
t AS (SELECT doc_id, s AS t, count(*) AS f FROM flat JOIN stems USING (w) GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS dl FROM flat GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM flat) / (SELECT count(*) FROM documents) AS a),
hit AS (SELECT * FROM t SEMI JOIN (SELECT DISTINCT s FROM q_stems) ON s = t.t), df AS (SELECT t, count(*) AS df FROM hit GROUP BY 1)
SELECT doc_id, round(sum(ln(greatest(1, (n - df + 0.5) / (df + 0.5))) * f / (f + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
FROM hit JOIN df USING (t) JOIN dl USING (doc_id), st GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""")
def stemmed_search(t):
    """BM25 over an index of stems without stop words, the query's words taken the same way."""
    asked = t.benchmark.where("item_id = 0").select("text").first()
    terms = sparse.query_terms(asked[0], "english", text.STOP_WORDS) if asked and asked[0] else []
    return sparse.search(stemmed_index(t), terms, 10).withColumnRenamed("item", "doc_id")


def _asked_list(t):
    found = t.embeddings.where("vec_id = 0").select("embedding").first()
    return list(found[0]) if found and found[0] else [0.0]


@query(f"SELECT vec_id, score FROM ({_VEC}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_index_topk(t):
    """From the stored index, read cell by cell until no cell that is left can hold a better vector: the exact result."""
    return vectors_index(t).search(_asked_list(t), 10).select(F.col("item").alias("vec_id"), "score")


@query(f"SELECT vec_id, label, score FROM ({_VEC}) WHERE label % 2 = 1 AND score >= -0.2 ORDER BY score DESC, vec_id LIMIT 25")
def vector_index_filtered(t):
    """A filter that half of the rows pass, and a threshold: the index is read on until the list is full and exact."""
    found = vectors_index(t).search(_asked_list(t), 25, where=F.col("label") % 2 == 1, threshold=-0.2)
    return found.select(F.col("item").alias("vec_id"), "label", "score")


_STATS = rf"""tok AS (SELECT doc_id, lang, {_W} AS w FROM documents), q AS (SELECT DISTINCT unnest({_W}) AS t FROM benchmark WHERE item_id = 0),
st AS (SELECT lang, count(*) AS n, avg(len(w)) AS a FROM tok GROUP BY 1), tf AS (SELECT doc_id, lang, dl, t, count(*) AS f FROM (SELECT doc_id, lang, len(w) AS dl, unnest(w) AS t FROM tok) SEMI JOIN q USING (t) GROUP BY ALL),
df AS (SELECT lang, t, count(*) AS df FROM tf GROUP BY 1, 2)"""


_UPDATED = rf"""now AS (
  SELECT CASE WHEN source = 'src2' THEN text || ' ' || lang ELSE text END AS text, doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'
  UNION ALL SELECT text, -1 - item_id FROM benchmark),
tok AS (SELECT doc_id, {_W} AS w FROM now), q AS (SELECT DISTINCT unnest({_W}) AS t FROM benchmark WHERE item_id = 0),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok), tf AS (SELECT doc_id, dl, t, count(*) AS f FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM tok) SEMI JOIN q USING (t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1)"""


@query(f"WITH {_UPDATED} SELECT doc_id, round(sum(ln(greatest(1, (n - df + 0.5) / (df + 0.5))) * f / (f + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (t), st GROUP BY 1")
def sparse_index_update(t):
    """The index of all documents, from which one source's are removed, to which the benchmark's texts are added, and in which another source's documents are
    replaced: every score is that of a fresh index of what there is in the end."""
    index = SegmentedIndex(t.spark, f"{shared_folder(t.spark)}/updated-{uuid.uuid4().hex}")
    index.add(t.documents, "doc_id", "text")
    index.remove(t.documents.where("source = 'src1'").select(F.col("doc_id").alias("item")))
    index.add(t.benchmark.select((-1 - F.col("item_id")).alias("id"), "text"), "id", "text")
    index.add(t.documents.where("source = 'src2'").select("doc_id", F.concat_ws(" ", "text", "lang").alias("text")), "doc_id", "text")
    asked = t.benchmark.where("item_id = 0").select("text").first()
    found = sparse.scores(index.open(), retrieval.query_terms(asked[0]) if asked and asked[0] else [])
    return found.select(F.col("item").alias("doc_id"), "score")


@query("SELECT s_suppkey AS key FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def refresh_prune(t):
    """Suppliers are known under three prefixes; even customers are fresh, of which two prefixes were reached, one of them without giving anything."""
    prefix = lambda n: F.concat(F.element_at(F.array(F.lit("a:"), F.lit("b:"), F.lit("c:")), (n % 3 + 1).cast("int")), n.cast("string"))
    fresh = t.customer.where("c_custkey % 2 = 0 and c_custkey % 3 <> 1").select(prefix(F.col("c_custkey")).alias("key"))
    gone = state.prunable(t.supplier.select(prefix(F.col("s_suppkey")).alias("key")), fresh, ["a", "b"])
    return gone.select(F.substring_index("key", ":", -1).cast("long").alias("key"))


@query("SELECT user_id, event_id, ts, true AS truncated FROM events ORDER BY ts DESC, event_id LIMIT 20")
def truncated_list(t):
    return listings.truncated(t.events.select("user_id", "event_id", "ts"), [F.desc("ts"), "event_id"], 20)


@query(f"""WITH {_STATS}, bm AS (SELECT doc_id, lang, round(sum(ln(greatest(1, (n - df + 0.5) / (df + 0.5))) * f / (f + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (lang, t) JOIN st USING (lang) GROUP BY 1, 2)
SELECT lang AS knowledge_base, doc_id, score, 'broken: no index' AS failed FROM bm WHERE lang IN (SELECT DISTINCT lang FROM documents ORDER BY lang LIMIT 3) ORDER BY score DESC, doc_id LIMIT 10""")
def fanned_out(t):
    """Three languages are asked side by side, each a knowledge base with statistics of its own, and one base that fails."""
    asked = t.benchmark.where("item_id = 0").select("text").first()
    terms = retrieval.query_terms(asked[0]) if asked and asked[0] else []
    index = documents_index(t)

    def base(kb):
        own = sparse.Index(index.postings.where(F.col("kb") == kb), index.totals.where(F.col("kb") == kb))
        return lambda: sparse.scores(own, terms).select("item", "score")

    def broken():
        raise LookupError("no index")

    names = [r[0] for r in t.documents.select("lang").where("lang is not null").distinct().orderBy("lang").limit(3).collect()]
    found, errors = retrieval.fanned_out({n: base(n) for n in names} | {"broken": broken}, "item", 10, seconds=600)
    told = ", ".join(f"{n}: {e}" for n, e in errors.items())
    return found.select("knowledge_base", F.col("item").alias("doc_id"), "score", F.lit(told).alias("failed"))


# -- table functions ---------------------------------------------------------------------


def _with_functions(t):
    """Customers are sources, their segment tells whether they are extracted; nations that ordered are the knowledge bases that indexed them; events are runs."""
    t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("extracted").alias("extraction_status")).createOrReplaceTempView("fathom_sources")
    t.orders.select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).cast("long").alias("knowledge_base_id")).createOrReplaceTempView("fathom_indexed")
    runs = t.events.select(F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("user_id").alias("total_tokens"), "event_id")
    runs.createOrReplaceTempView("fathom_runs")
    table_functions.register(t.spark, "fathom_sources", "fathom_indexed", "fathom_runs")
    return t.spark


@query("""WITH e AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING' AND contains(lower(c_name), '#00000')
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'))
SELECT id, name, (SELECT count(*) FROM e) AS total_count FROM e ORDER BY name, id LIMIT 20 OFFSET 5""")
def sources_function(t):
    """A page of what a knowledge base lacks, by a function of SQL."""
    return _with_functions(t).sql("SELECT * FROM list_sources_excluding(1, '#00000', 20, 5)")


@query("""SELECT date_trunc('day', ts) AS bucket, count(*) AS total_runs, count(*) FILTER (WHERE event_type = 'error') AS failed_runs, CAST(sum(user_id) AS BIGINT) AS total_tokens, max(ts) AS last_activity_at
FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1""")
def buckets_function(t):
    """Buckets of runs by a function of SQL; a unit that there isn't adds nothing."""
    return _with_functions(t).sql("SELECT * FROM run_buckets(TIMESTAMP '2024-01-03', 'day') UNION ALL SELECT * FROM run_buckets(TIMESTAMP '2024-01-03', 'week')")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, n, event_id, true AS accepted, [ts] AS held FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, len(list_filter(r.held, lambda x: x > o.ts - INTERVAL 1 DAY)) < 2,
  CASE WHEN len(list_filter(r.held, lambda x: x > o.ts - INTERVAL 1 DAY)) < 2 THEN list_append(list_filter(r.held, lambda x: x > o.ts - INTERVAL 1 DAY), o.ts) ELSE r.held END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r""")
def rate_function(t):
    """A table function with state over a partitioned and ordered table argument."""
    t.events.where("event_type = 'error'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).createOrReplaceTempView("fathom_errors")
    asked = "SELECT user_id, event_id, accepted FROM rate_limited(TABLE(fathom_errors) PARTITION BY user_id ORDER BY (ts, event_id), 'ts', 2, 86400)"
    return _with_functions(t).sql(asked)
