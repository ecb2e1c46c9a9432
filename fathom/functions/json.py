"""JSON functions as Column expressions over JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, key: str) -> Column:
    return F.get_json_object(value, f"$.{key}")


def as_int(value: Column) -> Column:
    """Empty and malformed values are null."""
    return F.nullif(value, F.lit("")).try_cast("int")


def matches(value: Column, wanted: dict[str, object]) -> Column:
    """Every key has the wanted scalar; one semantics for vector and sparse filters."""
    as_text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    out = F.lit(True)
    for key, v in wanted.items():
        out = out & F.coalesce(field(value, key) == F.lit(as_text(v)), F.lit(False))
    return out


def contains(value: Column, wanted: object) -> Column:
    """Whether a JSON text contains `wanted`: objects by their keys, arrays by their elements in any order, at any depth; scalars by value and kind.

    An array contains a scalar that is one of its elements only at the top. Null and malformed texts contain nothing.
    """
    whole = F.try_parse_json(value)
    found = _contains(whole, wanted)
    if not isinstance(wanted, (dict, list)):
        found = found | F.coalesce(F.exists(F.try_variant_get(whole, "$", "array<variant>"), _one(wanted)), F.lit(False))
    return F.coalesce(found, F.lit(False))


def _one(wanted: object):
    return lambda x: _contains(x, wanted)


def _contains(v: Column, wanted: object) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(wanted, dict):
        out = kind.startswith("OBJECT")
        for key, w in wanted.items():
            out = out & _contains(F.try_variant_get(v, f"$['{key}']", "variant"), w)
    elif isinstance(wanted, list):
        out = kind.startswith("ARRAY")
        for w in wanted:
            out = out & F.exists(F.try_variant_get(v, "$", "array<variant>"), _one(w))
    elif wanted is None:
        out = F.is_variant_null(v)
    elif isinstance(wanted, bool):
        out = (kind == "BOOLEAN") & F.try_variant_get(v, "$", "boolean").eqNullSafe(F.lit(wanted))
    elif isinstance(wanted, str):
        out = (kind == "STRING") & F.try_variant_get(v, "$", "string").eqNullSafe(F.lit(wanted))
    else:
        out = ~kind.isin("STRING", "BOOLEAN") & F.try_variant_get(v, "$", "double").eqNullSafe(F.lit(float(wanted)))
    return F.coalesce(out, F.lit(False))


def as_map(value: Column) -> Column:
    """Keys to values of any depth; null for what is no object."""
    return F.from_json(value, "map<string,variant>")


def without(value: Column, keys: list[str]) -> Column:
    """The object without these keys, as a map."""
    return F.map_filter(as_map(value), lambda k, _: ~k.isin(*keys))


def only(value: Column, keys: list[str]) -> Column:
    return F.map_filter(as_map(value), lambda k, _: k.isin(*keys))


def without_nulls(value: Column) -> Column:
    return F.map_filter(as_map(value), lambda _, v: ~F.is_variant_null(v))


def has_any(value: Column, keys: list[str]) -> Column:
    """Whether the object has one of the keys, whatever its value."""
    out = F.lit(False)
    for k in keys:
        out = out | F.map_contains_key(as_map(value), k)
    return F.coalesce(out, F.lit(False))


def merged(left: Column, right: Column) -> Column:
    """Maps, the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def with_field(value: Column, key: str, new: Column) -> Column:
    """The JSON object with one key set to a JSON value; null counts as an empty object, other values stay as they are."""
    held = as_map(F.coalesce(value, F.lit("{}")))
    return F.coalesce(F.to_json(merged(held, F.create_map(F.lit(key), F.parse_json(new)))), value)


def is_array(value: Column) -> Column:
    """Whether a text is a JSON array."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("ARRAY"), F.lit(False))


def full_or_preview(full: Column, preview: Column) -> Column:
    return F.coalesce(full, preview)


def differs(a: Column, b: Column, ignoring: list[str] | None = None) -> Column:
    """Whether two objects differ, apart from some keys; the order of keys is no difference. Null differs from an object."""
    def flat(v: Column) -> Column:
        # keys of nested objects are in order in a variant's text
        held = F.map_entries(without(v, ignoring) if ignoring else as_map(v))
        return F.array_sort(F.transform(held, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))

    return ~flat(a).eqNullSafe(flat(b))


def usage(value: Column) -> list[Column]:
    """prompt_tokens, completion_tokens and total_tokens with fallbacks: details nested under `usage`, total as their sum."""
    part = lambda k: F.coalesce(as_int(field(value, k)), as_int(F.get_json_object(value, f"$.usage.{k}")))
    prompt, completion = part("prompt_tokens"), part("completion_tokens")
    total = F.coalesce(part("total_tokens"), F.when(prompt.isNotNull() | completion.isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))))
    return [prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens")]


def packed(**values: Column) -> Column:
    """An object of the values that are not null; null if all are."""
    some = F.lit(False)
    for v in values.values():
        some = some | v.isNotNull()
    return F.when(some, F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])))


def coerced(value: Column, kind: str, choices: list[str] | None = None) -> Column:
    """A model's answer as text, boolean, number or enum (without regard to case); what doesn't fit is null."""
    text = F.trim(value)
    if kind == "number":
        return text.try_cast("double")
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "yes", "1"), F.lit(True)).when(low.isin("false", "no", "0"), F.lit(False))
    if kind == "enum":
        out = F.lit(None).cast("string")
        for c in choices or []:
            out = F.when(F.lower(text) == c.lower(), F.lit(c)).otherwise(out)
        return out
    if kind == "text":
        return value.cast("string")
    raise ValueError(f"unknown field type {kind}")
