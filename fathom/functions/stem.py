"""Stems of English words by the published rules of the Snowball stemmer for English (Porter2), and their use on columns.

Rules are tables of (endings, what takes their place, where); one small engine applies them. A table's longest ending that
fits decides alone: if its condition does not hold, no shorter one is tried.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the published algorithm.
SPECIAL = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split())
INVARIANT = set("sky news howe atlas cosmos bias andes".split())
INVARIANT_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
EARLY_R1 = re.compile("gener|commun|arsen")
STEP_2 = dict(
    x.split(":")
    for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous "
    "ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split()
)
STEP_3 = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
LI_ENDING = "cdeghkmnrt"

_REGION = re.compile(r"^.*?[aeiouy][^aeiouy]", re.S)
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", re.S)
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    found = _REGION.match(word[start:])
    return start + found.end() if found else len(word)


def _longest(word: str, endings: dict[str, str]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(200_000)
def english(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    w = word[1:] if word[0] == "'" else word
    if w in SPECIAL:
        return SPECIAL[w]
    if w in INVARIANT:
        return w
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    early = EARLY_R1.match(w)
    r1 = early.end() if early else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub("(?:'s'|'s|')$", "", w)
    w = _plural(w)
    if w in INVARIANT_AFTER_1A:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for table, conditions in ((STEP_2, _step_2), (STEP_3, _step_3), (STEP_4, _step_4)):
        end = _longest(w, table)
        if end is not None and conditions(w[: -len(end)], end, r1, r2):
            w = w[: -len(end)] + table[end]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1], re.S):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, dict.fromkeys(("eed", "eedly", "ed", "edly", "ing", "ingly"), ""))
    if end is None:
        return w
    rest = w[: -len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else w
    if not re.search("[aeiouy]", rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _SHORT.search(rest) else rest


def _step_2(rest: str, end: str, r1: int, r2: int) -> bool:
    fits = rest.endswith("l") if end == "ogi" else bool(rest) and rest[-1] in LI_ENDING if end == "li" else True
    return len(rest) >= r1 and fits


def _step_3(rest: str, end: str, r1: int, r2: int) -> bool:
    return len(rest) >= (r2 if end == "ative" else r1)


def _step_4(rest: str, end: str, r1: int, r2: int) -> bool:
    return len(rest) >= r2 and (end != "ion" or rest.endswith(("s", "t")))


#: Stemmers by name.
STEMMERS = {"english": english}


def _stemmer(language: str):
    if language not in STEMMERS:
        raise ValueError(f"no stemmer for {language!r}")
    return STEMMERS[language]


def stemmed(word: Column, language: str = "english") -> Column:
    """A column of words as stems, a batch at a time; stems of words met before come from a table of bounded size."""
    stem = _stemmer(language)

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return stems(word)


def stemmed_all(words: Column, language: str = "english") -> Column:
    """An array of words as an array of stems."""
    stem = _stemmer(language)

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [w if w is None else stem(w) for w in x])

    return stems(words)
