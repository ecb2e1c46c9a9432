"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import stem

#: Runs of letters, marks, digits and underscores of any script.
WORDS = r"[\p{L}\p{M}\p{N}_]+"


def escape_like(text: str) -> str:
    """A literal for LIKE: backslash, percent and underscore lose their meaning."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def contains_literal(value: Column, needle: str) -> Column:
    """Case-insensitive literal substring; wildcards in the needle are ordinary characters."""
    return F.contains(F.lower(value), F.lit(needle.lower()))


def preview(value: Column, size: int = 500) -> Column:
    return F.left(value, F.lit(size))


def shortened(value: Column, most: int = 200) -> Column:
    """Longer than `most`: cut so that it ends in ... and has `most` characters."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 3)), F.lit("..."))).otherwise(value)


def marked_cut(value: Column, most: int = 500, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit(mark))).otherwise(value)


def citations(value: Column) -> Column:
    """Distinct numbers of [n] markers, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(r"\[(\d+)\]"), F.lit(1)))


def without_citations(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s*\[\d+\]", ""))


def valid_citations(value: Column, known: Column) -> Column:
    """Those of `known` that occur, by number."""
    return F.array_sort(F.transform(F.array_intersect(citations(value), known), lambda x: x.cast("int")))


def strip_unknown(value: Column, known: Column) -> Column:
    """Markers whose number is not known disappear."""
    return F.aggregate(F.array_except(citations(value), known), value, lambda text, n: F.replace(text, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))


def plain_text(markdown: Column) -> Column:
    """Markdown as text. Code, fenced or in backticks, stays as it stands; of the rest go fences' lines, rules, marks of headings, quotes and emphasis, and targets of links and images.

    The text is split at code first, so that no mark inside it is taken for one.
    """
    pieces = F.split(markdown, r"(?m)(?=^ {0,3}```)", -1)  # a piece starts with each fence: text and code take turns
    fenced = lambda s: F.regexp_replace(s, r"^ {0,3}```[^\n]*\n?", "")
    starts = F.when(markdown.rlike(r"^ {0,3}```"), 0).otherwise(1)
    is_code = lambda s, i: (i >= starts) & ((i - starts) % 2 == 0)
    told = F.transform(pieces, lambda s, i: F.when(is_code(s, i), fenced(s)).otherwise(_prose(fenced(s))))
    joined = F.regexp_replace(F.array_join(told, ""), r"\n(?:[ \t]*\n){2,}", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def _prose(value: Column) -> Column:
    """Text without fences: spans in backticks are split off, and marks go from what is between."""
    spans = F.split(value, "`", -1)
    closed = F.size(spans) - F.when(F.size(spans) % 2 == 0, 1).otherwise(0)  # a last backtick without a partner is a character

    def bare(s: Column) -> Column:
        s = F.regexp_replace(s, r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s[^()]*)?\)", "$1")
        s = F.regexp_replace(s, r"(?m)^[ \t]*(?:([-*_])[ \t]*)(?:\1[ \t]*){2,}$", "")
        s = F.regexp_replace(s, r"(?m)^[ \t]*(?:#{1,6}[ \t]+|>[ \t]?)+", "")
        s = F.regexp_replace(s, r"(\*{1,3}|~~)(?=\S)([^*~\n]*[^*~\s])\1", "$2")
        return F.regexp_replace(s, r"(?<![A-Za-z0-9_])(_{1,3})(?=\S)([^_\n]*[^_\s])\1(?![A-Za-z0-9_])", "$2")

    told = F.transform(spans, lambda s, i: F.when(i >= closed, F.concat(F.lit("`"), bare(s))).when(i % 2 == 1, s).otherwise(bare(s)))
    return F.array_join(told, "")


def document_title(content: Column, fallback: Column) -> Column:
    """The first line that is a level-one heading or a `title:`; else, or where that is blank after `title:`, the fallback."""
    lines = F.transform(F.split(content, r"\r\n|\n|\r"), lambda s: F.trim(s))
    hit = F.try_element_at(F.filter(lines, lambda s: s.startswith("# ") | F.lower(s).startswith("title:")), F.lit(1))
    named = F.regexp_replace(F.trim(F.regexp_replace(hit, r"^[^:]*:", "")), r"^[\"']+|[\"']+$", "")
    return F.when(hit.isNull(), fallback).when(hit.startswith("# "), F.trim(F.substring(hit, 3, 1 << 30))).otherwise(F.coalesce(F.nullif(named, F.lit("")), fallback))


def content_hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def tokens(value: Column) -> Column:
    """Lower-case words of any script."""
    return F.regexp_extract_all(F.lower(value), F.lit(WORDS), F.lit(0))


#: Words that say nothing of a text, as sparse retrieval leaves them out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def search_tokens(value: Column, stop_words: list[str] = STOP_WORDS, stemmer: str | None = "english") -> Column:
    """Words of two characters or more without stop words, as stems if there is a stemmer."""
    found = F.filter(tokens(value), lambda w: (F.length(w) > 1) & ~w.isin(stop_words))
    return stem.stemmed_all(found, stemmer) if stemmer else found


def token_estimate(value: Column) -> Column:
    return F.floor(F.length(value) / 4).cast("long")


def safe_file_name(name: Column) -> Column:
    """Storage key: only safe characters; a name that changed gets a suffix of its hash."""
    safe = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.when(safe == name, name).otherwise(F.concat(safe, F.lit("_"), F.left(F.sha2(name.cast("binary"), 256), F.lit(8))))


def reranker_text(body: Column, document: Column, title: Column, enrichment: Column) -> Column:
    """What a reranker reads: lines of document, section and metadata (a JSON object as `key: value, ...`), where there are any a blank line, and the text."""
    some = lambda label, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(label), v))
    held = F.map_entries(F.from_json(enrichment, "map<string,string>"))
    notes = F.array_join(F.transform(F.array_sort(held), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), ", ")
    head = F.concat_ws("\n", some("Document: ", document), some("Section: ", title), some("Metadata: ", notes))
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit(""))))


def embed_input(title: Column, summary: Column, references: Column, body: Column, most: int = 500) -> Column:
    """What a node is embedded by: title, summary and the titles it refers to; without any the first characters of its text."""
    some = lambda v: F.when(F.coalesce(v, F.lit("")) != "", v)
    told = F.when(F.size(references) > 0, F.concat(F.lit("References: "), F.array_join(references, ", ")))
    parts = F.concat_ws("\n", some(title), some(summary), told)
    return F.when(parts == "", F.left(F.coalesce(body, F.lit("")), F.lit(most))).otherwise(parts)


def summary_input(body: Column, most_tokens: int, chars: int = 100_000) -> Column:
    """A text cut to its first words, of which a token is one with the white space before it; a text without words to its first characters."""
    words = F.regexp_extract_all(body, F.lit(r"\s*\S+"), F.lit(0))
    return F.when(F.size(words) > most_tokens, F.array_join(F.slice(words, 1, most_tokens), "")).when(F.size(words) == 0, F.left(body, F.lit(chars))).otherwise(body)


def sentences(value: Column) -> Column:
    """(sentence, mark) of a text, split at . ! ? and line ends; the last may have no mark."""
    ends = F.regexp_extract_all(value, F.lit(r"[.!?\n]"), F.lit(0))
    parts = F.split(value, r"[.!?\n]", -1)
    return F.transform(parts, lambda s, i: F.struct(s.alias("sentence"), F.coalesce(F.get(ends, i), F.lit("")).alias("mark")))


def asserts(value: Column, done: list[str], planned: list[str], negation: str, condition: str) -> Column:
    """Whether a sentence that is no question says that something was done, or will be: patterns given by the caller, case aside.

    A negation anywhere vetoes the sentence; an offer or condition does so before a pattern of `done`, and anywhere for one of `planned`.
    """
    def says(s: Column) -> Column:
        low = F.lower(s)
        out = F.lit(False)
        for p in done:
            before = F.regexp_extract(low, rf"(?s)^(.*?)(?:{p})", 1)
            out = out | (low.rlike(p) & ~before.rlike(condition))
        for p in planned:
            out = out | (low.rlike(p) & ~low.rlike(condition))
        return out & ~low.rlike(negation)

    return F.coalesce(F.exists(sentences(value), lambda x: (x["mark"] != "?") & says(x["sentence"])), F.lit(False))


def first_line(value: Column, most: int = 160) -> Column:
    """The first line of an error note, cut."""
    return F.left(F.element_at(F.split(value, "\n"), 1), F.lit(most))


def annotation(title: Column, pages: Column, document: Column | None = None, more: Column | None = None) -> Column:
    """`Document: ... | Section: ... | Page(s): ...`, empty parts left out; `more` is an array of further parts."""
    some = lambda label, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(label), v))
    page = F.when(F.size(pages) > 1, F.concat(F.lit("Pages: "), pages[0].cast("string"), F.lit("-"), F.element_at(pages, -1).cast("string"))).when(F.size(pages) == 1, F.concat(F.lit("Page: "), pages[0].cast("string")))
    parts = [some("Document: ", document)] if document is not None else []
    return F.concat_ws(" | ", *parts, some("Section: ", title), page, *([more] if more is not None else []))
