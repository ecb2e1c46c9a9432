"""Parameters and guards in plain Python: list parameters, identifiers, SQL, field definitions, settings, strategies, search syntax."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.text import WORDS

# -- list parameters ------------------------------------------------------------


@dataclass(frozen=True)
class ListParams:
    limit: int
    offset: int
    q: str | None
    sort: str
    descending: bool


def _number(value, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def list_params(args: dict, sorts: list[str], default_limit: int = 50, most: int = 100) -> ListParams:
    """limit within 1 to `most`, offset from 0, q trimmed and at most 200 characters, sort from a list (its first by default), order asc or desc.

    ValueError for a sort or an order that is given and unknown.
    """
    q = str(args.get("q") or "").strip()[:200] or None
    sort, order = args.get("sort") or sorts[0], str(args.get("order") or "desc").lower()
    if sort not in sorts:
        raise ValueError(f"sort must be one of {', '.join(sorts)}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    return ListParams(min(max(_number(args.get("limit"), default_limit), 1), most), max(_number(args.get("offset"), 0), 0), q, sort, order == "desc")


# -- identifiers and fields -------------------------------------------------------

_IDENTIFIER = re.compile(r"[a-zA-Z][a-zA-Z0-9_]*")
# Names the enrichment tables use themselves, and the kinds of fields.
RESERVED_FIELDS = {"id", "item_id", "item_type", "enriched_at", "_enrichment_error"}
FIELD_TYPES = {"text": T.StringType(), "boolean": T.BooleanType(), "number": T.DoubleType(), "enum": T.StringType()}


def identifier(name: str, most: int = 50) -> str:
    if not isinstance(name, str) or len(name) > most or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def check_fields(fields: list[dict]) -> list[str]:
    """Problems of enrichment field definitions; none if they are fine."""
    if not isinstance(fields, list) or not fields:
        return ["fields must be a list with entries"]
    problems, seen = [], set()
    for at, f in enumerate(fields):
        name = f.get("name") if isinstance(f, dict) else None
        try:
            low = identifier(name).lower()
        except ValueError:
            problems.append(f"field {at}: bad name")
            continue
        if low in RESERVED_FIELDS or low in seen:
            problems.append(f"field {at}: name is taken")
        seen.add(low)
        if not isinstance(f.get("description"), str) or not f["description"]:
            problems.append(f"field {at}: no description")
        if f.get("type") not in FIELD_TYPES:
            problems.append(f"field {at}: unknown type")
        values = f.get("enum_values")
        if f.get("type") == "enum" and not (isinstance(values, list) and len(values) > 1 and all(isinstance(v, str) and v.strip() for v in values)):
            problems.append(f"field {at}: an enum needs two values or more")
    return problems


def field_schema(fields: list[dict]) -> T.StructType:
    """The row type of a knowledge base's own metadata table."""
    if problems := check_fields(fields):
        raise ValueError("; ".join(problems))
    own = [T.StructField("item_id", T.StringType(), False), T.StructField("item_type", T.StringType())]
    return T.StructType([*own, *[T.StructField(f["name"], FIELD_TYPES[f["type"]]) for f in fields], T.StructField("enriched_at", T.TimestampType()), T.StructField("_enrichment_error", T.StringType())])


def field_json_schema(fields: list[dict]) -> dict:
    """What a model is asked to answer with."""
    kinds = {"text": "string", "boolean": "boolean", "number": "number", "enum": "string"}
    each = {f["name"]: {"type": kinds[f["type"]], "description": f["description"]} | ({"enum": f["enum_values"]} if f["type"] == "enum" else {}) for f in fields}
    return {"type": "object", "properties": each, "required": [f["name"] for f in fields]}


# -- requests -----------------------------------------------------------------------


def request_problem(entries: object, most: int = 10) -> str | None:
    """Why knowledge bases named by a request can't be used, or None: at most so many objects of unique ids, with top_k 1 to 100, threshold 0 to 1, a known method."""
    if not isinstance(entries, list) or not entries:
        return "a list with entries is needed"
    if len(entries) > most:
        return f"at most {most} entries"
    seen = set()
    for at, e in enumerate(entries):
        if not isinstance(e, dict) or not e.get("id"):
            return f"entry {at}: no id"
        if unknown := set(e) - REQUEST_KEYS:
            return f"entry {at}: unknown keys {sorted(unknown)}"
        if e["id"] in seen:
            return f"entry {at}: id {e['id']} is there twice"
        seen.add(e["id"])
        number = lambda v, kinds: isinstance(v, kinds) and not isinstance(v, bool)
        if (k := e.get("top_k")) is not None and not (number(k, int) and 1 <= k <= 100):
            return f"entry {at}: top_k is 1 to 100"
        if (x := e.get("similarity_threshold")) is not None and not (number(x, (int, float)) and 0 <= x <= 1):
            return f"entry {at}: similarity_threshold is 0 to 1"
        if e.get("retrieval_method") is not None and not any(e["retrieval_method"] in s["retrievers"] for s in STRATEGIES.values()):
            return f"entry {at}: unknown method"
        if e.get("filter_metadata") is not None and not isinstance(e["filter_metadata"], dict):
            return f"entry {at}: filter_metadata is no object"
    return None


# What an entry of a request may name.
REQUEST_KEYS = {"id", "top_k", "retrieval_method", "similarity_threshold", "filter_metadata", "max_context_tokens", "source_ids"}


def setting(value: str | None, kind: str, default, low=None, high=None, choices: list[str] | None = None):
    """A stored setting as int, float, bool or str; the default where nothing is stored or it can't be read so. low, high and choices are checked by setting_problem."""
    if value is None:
        return default
    try:
        return {"int": int, "float": float, "bool": lambda v: v.lower() in ("true", "1", "yes"), "str": str}[kind](value)
    except ValueError:
        return default


def setting_problem(value, kind: str, low=None, high=None, choices: list[str] | None = None) -> str | None:
    """Why a new value of a setting is refused, or None."""
    held = setting(str(value), kind, None)
    if held is None:
        return f"no {kind}: {value}"
    if kind in ("int", "float") and ((low is not None and held < low) or (high is not None and held > high)):
        return f"must be within {low} to {high}"
    return f"must be one of {', '.join(choices)}" if choices and str(value) not in choices else None


# -- SQL guards -------------------------------------------------------------------

# What may run, and schemas that are out of bounds.
STATEMENTS = {"SELECT", "INSERT", "UPDATE", "DELETE", "WITH", "EXPLAIN"}
DDL_VERBS = {"CREATE", "ALTER", "DROP"}
DDL_TARGETS = {"TABLE", "INDEX", "VIEW"}
DDL_BETWEEN = {"UNIQUE", "CONCURRENTLY", "OR", "REPLACE", "TEMPORARY", "TEMP", "IF", "NOT", "EXISTS", "UNLOGGED"}
PROTECTED = {"ai", "auth", "storage", "realtime", "extensions", "pgbouncer", "pgsodium", "vault", "supabase_migrations", "information_schema", "pg_catalog"}

_LEXEMES = re.compile(r"""(?P<string>'(?:[^']|'')*'?)|(?P<name>"(?:[^"]|"")*"?)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<dollar>\$\w*\$)|(?P<end>;)|(?P<word>\w+)|(?P<space>\s+)|(?P<other>.)""", re.S)


def sql_problem(sql: str) -> str | None:
    """Why a statement may not run, or None. One lexer pass; comments count as space, contents of strings as nothing."""
    lexemes = [(m.lastgroup, m[0]) for m in _LEXEMES.finditer(sql)]
    code = [x for x in lexemes if x[0] not in ("comment", "space")]
    while code and code[-1][0] == "end":
        code.pop()
    if not code:
        return "empty statement"
    if any(kind == "dollar" for kind, _ in code):
        return "dollar quoting is not allowed"
    if any(kind == "end" for kind, _ in code):
        return "only one statement is allowed"
    words = [text.upper() for kind, text in code if kind == "word"]
    verb = words[0] if code[0][0] == "word" else code[0][1]
    if verb in DDL_VERBS:
        target = next((w for w in words[1:] if w not in DDL_BETWEEN), "")
        if target not in DDL_TARGETS:
            return f"not allowed: {verb} {target}".rstrip()
    elif verb not in STATEMENTS:
        return f"not allowed: {verb}"
    for (kind, text), (_, dot) in zip(code, code[1:]):
        if dot == "." and kind in ("word", "name") and text.strip('"').lower() in PROTECTED:
            return f"protected schema: {text}"
    return None


def read_only_problem(sql: str) -> str | None:
    """The guard of the read-only tool: one SELECT, no semicolon anywhere."""
    if not sql.strip().upper().startswith("SELECT"):
        return "only SELECT"
    return "no semicolons" if ";" in sql else None


def run_read_only(spark, sql: str, most_chars: int = 50_000) -> str:
    """Rows as JSON lines, cut at a number of characters; raises ValueError for what the guard refuses."""
    if problem := read_only_problem(sql):
        raise ValueError(problem)
    out, size = [], 0
    for row in spark.sql(sql).toJSON().toLocalIterator():
        out.append(row)
        size += len(row) + 1
        if size > most_chars:
            break
    return "\n".join(out)[:most_chars]


# -- strategies -------------------------------------------------------------------

# Names of strategies and retrievers that callers give.
_BY_RANK = ("vector_search", "full_text", "hybrid")
STRATEGIES = {
    "chunk_embed": {"retrievers": _BY_RANK, "default": "hybrid", "reranker": True},
    "page_index": {"retrievers": ("tree_search",), "default": "tree_search", "reranker": False},
    "full_document": {"retrievers": _BY_RANK, "default": "hybrid", "reranker": True},
    "graph_index": {"retrievers": _BY_RANK, "default": "hybrid", "reranker": True},
    "doc2json": {"retrievers": _BY_RANK, "default": "hybrid", "reranker": True},
}


def retriever(strategy: str, method: str | None = None) -> str:
    """The method to use, or ValueError if the strategy doesn't know it."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    known = STRATEGIES[strategy]
    if method is not None and method not in known["retrievers"]:
        raise ValueError(f"{strategy} does not support {method}")
    return method or known["default"]


def run_method(methods: dict[str, Callable], strategy: str, method: str | None = None, **given):
    """Call the builder of the method that a strategy uses; ValueError for what it doesn't support."""
    return methods[retriever(strategy, method)](**given)


def fetch_count(top_k: int, reranker_candidates: int | None = None, limited: bool = False) -> int:
    """Candidates to fetch: what a reranker wants, more when sources are limited, else k."""
    if reranker_candidates:
        return max(reranker_candidates, top_k)
    return min(5 * top_k, 200) if limited else top_k


def source_limits(config: dict | None) -> tuple[int | None, int | None]:
    """(floor, cap) per source; zero, negative and malformed values mean none."""
    read = lambda k: (n if (n := _number((config or {}).get(k), 0)) > 0 else None)
    return read("min_per_source"), read("max_per_source")


# -- web search syntax --------------------------------------------------------------


def search_condition(query: str, words: Column) -> Column:
    """A condition on an array of words: terms are ANDed, OR between them, -word excludes, "a b" is a phrase."""
    groups: list[Column] = []
    alternative = False
    import regex

    for negative, phrase, word in re.findall(r"(-?)(?:\"([^\"]*)\"|(\S+))", query.lower()):
        if word == "or" and not negative:
            alternative = bool(groups)
            continue
        parts = regex.findall(WORDS, phrase or word)
        if not parts:
            continue
        hit = F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(parts)} "))
        hit = ~hit if negative else hit
        groups[-1:] = [groups[-1] | hit] if alternative else [*groups[-1:], hit]
        alternative = False
    out = F.lit(bool(groups))
    for g in groups:
        out = out & g
    return out


# -- cron ---------------------------------------------------------------------------


def cron_fields(expression: str) -> list[set[int]]:
    """Minute, hour, day, month, weekday (0 is Sunday); lists, ranges and steps."""
    bounds = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    out = []
    for part, (lo, hi) in zip(parts, bounds):
        allowed: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (lo, hi) if span == "*" else (int(a), int(b) if b else (hi if step else int(a)))
            if not lo <= first <= last <= hi:
                raise ValueError(f"out of range: {item}")
            allowed |= set(range(first, last + 1, int(step or 1)))
        out.append(allowed)
    out[4] = {d % 7 for d in out[4]}
    return out


def cron_next(expression: str, after):
    """The next time a cron expression fires after a datetime, None within five years if it never does."""
    from datetime import timedelta

    minute, hour, day, month, weekday = cron_fields(expression)
    day_free, week_free = len(day) == 31, len(weekday) == 7
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = at + timedelta(days=5 * 366)
    while at < end:
        by_day, by_week = at.day in day, (at.weekday() + 1) % 7 in weekday
        fits = (by_day and by_week) if day_free or week_free else (by_day or by_week)
        if at.month not in month or not fits:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hour:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minute:
            at += timedelta(minutes=1)
        else:
            return at
    return None
