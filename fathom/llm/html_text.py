"""HTML main text by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with the path of
block-level tags (and their classes) from the root to it. For each path

    ratio = (characters of all its blocks outside links / its blocks)
            * (1 + punctuation marks of its blocks / its blocks)
            * (1 + standard deviation of the characters) * (1 + standard deviation of the punctuation)

fuses text length and punctuation: a text's paragraphs are long and differ, the parts of a layout are short and alike. Blocks, in page order, get the logarithm of their path's ratio, smoothed with
their neighbours' (1/4, 1/2, 1/4); a path's level is the mean over its blocks. Paths at least `strength` of the way up from
the page's least level to its greatest (that of the article or main, if there is one) select the content nodes, inside an article as elsewhere.
Elements that are never main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments, hidden ones) can't be selected; where only a word of a class or id or a form says so, what it holds can outweigh it.
All blocks of the selected paths are the result, wherever they stand. Of the other blocks, headings right before a
kept block stay, and list items, cells, quotes and bare text that stand in the same element as selected blocks, in the content's
element or between selected blocks: their length says nothing, their place does. The content's element is found from the root down
by following the child with most of the selected text.

Reading is linear in the page, whatever is broken in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: How far up from the least level to the greatest a path has to be.
STRENGTH = 0.6

# Names of HTML's elements by their role, and words that sites use in classes and ids.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rtc rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea iframe svg math object canvas audio video select title".split())
NEVER = frozenset("nav footer aside head button menu dialog fieldset option search".split())
# Of those, the ones that a page without their closing tag leaves open to its end, as browsers do; and those that "/>" closes.
OPEN_ENDED = frozenset("script style textarea title iframe noscript".split())
SELF_CLOSED = frozenset("svg math".split())
LEAVES = frozenset("p li dt dd td th pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOME = frozenset("article main".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner".split())
SIDE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead topbar toolbar pager pagination related recommended trending popular widget share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay toast skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist replies reply respond disqus discussion responses".split())
# Of those, the ones that are also names of an article's own parts.
PART_WORDS = frozenset("discussion responses".split())
TEASER_WORDS = AD_WORDS | frozenset("related recommended trending popular".split())
PLACE_WORDS = frozenset("site left right top bottom primary secondary mobile desktop".split())
COMMENT_PARTS = frozenset("list area section form thread".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
# Elements that hold or group a text's parts, not other matter.
STRUCTURE = LEAVES | frozenset("ul ol dl table thead tbody tfoot tr figure hgroup header center".split())
#: Elements inside each other beyond which new ones become neighbours, as in browsers.
DEPTH = 512
# Why an element is no main text: for certain, or by a word or a form, which what it holds can outweigh.
CERTAIN, LAYOUT, TEASER, COMMENT = 1, 2, 3, 4

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+")
_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SKIPPED}
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¡¿«»\"“”'()]")


class Element:
    """path: a number for the names from the root to here; in_home: inside an article or main; veto: why it may be no main text, 0 if nothing says so; away: whether it is none, see judge()."""

    __slots__ = ("tag", "path", "parent", "veto", "away", "mass", "children", "in_home", "inside", "depth")

    def __init__(self, tag: str, path: int, parent: Element | None, veto: int):
        self.tag, self.path, self.parent = tag, path, parent
        self.depth = parent.depth + 1 if parent else 0
        self.veto = CERTAIN if parent and parent.veto == CERTAIN else veto
        self.away = self.veto != 0 or (parent.away if parent else False)
        self.in_home = tag in HOME or (parent.in_home if parent else False)
        self.mass, self.children, self.inside = 0.0, [], False
        if parent:
            parent.children.append(self)


def _veto(tag: str, found: dict[str, str], parent: Element) -> int:
    """Why an element, by its tag or attributes, is no main text; 0 if nothing says so."""
    role = found.get("role", "").lower()
    if tag in NEVER or "hidden" in found or found.get("aria-hidden") == "true" or role in AWAY_ROLES:
        return CERTAIN
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return CERTAIN
    if tag == "header" and not parent.in_home:
        return CERTAIN
    if tag in ("html", "body"):
        return 0
    names = found.get("class", "").split()
    listed = [_listed(n) for n in {*names, *found.get("id", "").split()}]
    if COMMENT in listed and (tag not in HOME or {n.lower() for n in names} & COMMENT_WORDS):
        part = parent.in_home and {n.lower() for n in (*names, *found.get("id", "").split()) if _listed(n) == COMMENT} <= PART_WORDS
        return 0 if part else COMMENT
    if tag in HOME or tag in HEADINGS:
        return 0
    return LAYOUT if LAYOUT in listed else TEASER if TEASER in listed else LAYOUT if tag == "form" or role == "form" else 0


@lru_cache(100_000)
def _listed(name: str) -> int:
    """The list that a whole class or id stands in, alone ("sidebar") or made of listed words and words of place ("sidebar-left"); 0 for other compounds ("has-sidebar")."""
    words = {name.lower()}
    if not words & (AD_WORDS | SIDE_WORDS | COMMENT_WORDS):
        words = {w.lower() for w in _WORDS.findall(name) if not w.isdigit()} - PLACE_WORDS
    if words & COMMENT_WORDS and words <= COMMENT_WORDS | COMMENT_PARTS:
        return COMMENT
    if words and words <= AD_WORDS | SIDE_WORDS:
        return TEASER if words & TEASER_WORDS else LAYOUT
    return 0


def judge(elements: list[Element], found: list[Block], high: list[bool]) -> None:
    """Set away. high: the blocks over the threshold.

    What is no main text for certain stays away. A word or a form is outweighed by a main inside; by an article inside, if
    it is no word for adverts or teasers; and by most of the page's high text, unless an article or main outside has some. Comments are outweighed by
    a main, or if no high text and no text of an article or main is left without them.
    """
    text = dict.fromkeys(elements, 0)
    own = dict.fromkeys(elements, 0)
    homes: dict[Element, set[str]] = {}
    for b, h in zip(found, high):
        if h and b.element.veto != CERTAIN:
            text[b.element] += len(b.text) - b.linked
            own[b.element] += len(b.text) - b.linked if b.element.in_home else 0
    for e in reversed(elements):
        if e.veto == CERTAIN or e.parent is None:
            continue
        text[e.parent] += text[e]
        own[e.parent] += own[e]
        up = homes.get(e, set()) if e.veto != COMMENT else set()
        up = up | {e.tag} if e.tag in HOME and e.veto != COMMENT else up
        if up:
            homes.setdefault(e.parent, set()).update(up)
    total, at_home = text[elements[0]], own[elements[0]]

    def outweighed(e: Element) -> bool:
        inside = homes.get(e, ())
        if "main" in inside or (e.veto == LAYOUT and "article" in inside):
            return True
        return e.veto != COMMENT and 2 * text[e] > total and (e.in_home or own[e] == at_home)

    for e in elements:
        e.away = e.veto == CERTAIN or (e.parent is not None and e.parent.away) or (e.veto != 0 and not outweighed(e))
    if not any((h or b.element.in_home) and not b.element.away for b, h in zip(found, high)):
        for e in elements:
            e.away = e.veto == CERTAIN or (e.parent is not None and e.parent.away) or (e.veto not in (0, COMMENT) and not outweighed(e))


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _events(page: str) -> Iterator[tuple[str, bool, str]]:
    """("", False, text) and (tag, whether it closes, what follows its name) in order. Comments and skipped elements are left out.

    A tag whose quotes are never closed ends at the next ">", as do those before the open quote; without one the rest is text.
    """
    at = end = loose = 0
    unclosed: set[str] = set()  # skipped elements that no closing tag follows any more
    while (at := page.find("<", at)) >= 0:
        m = None
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = stop + 3 if stop >= 0 else len(page)
        elif page.startswith(("<!", "<?"), at):
            stop = page.find(">", at) + 1
        elif m := _NAME.match(page, at):
            stop = m.end()
            if at >= loose:
                stop = _INSIDE.match(page, stop).end()
                if not page.startswith(">", stop):
                    loose = stop
            stop = (stop if at >= loose else page.find(">", m.end())) + 1
        else:
            at += 1
            continue
        if not stop:
            break
        if at > end:
            yield "", False, page[end:at]
        end = at = stop
        if m is None:
            continue
        tag, closing, rest = m[2].lower(), bool(m[1]), page[m.end() : stop - 1]
        if tag not in SKIPPED:
            yield tag, closing, rest
        elif not closing and not (tag in SELF_CLOSED and rest.endswith("/")) and tag not in unclosed:
            if last := _CLOSES[tag].search(page, end):
                end = at = page.find(">", last.end()) + 1 or len(page)
            elif tag in OPEN_ENDED:
                end = at = len(page)
            else:
                unclosed.add(tag)
    if end < len(page):
        yield "", False, page[end:]


def blocks(page: str) -> tuple[list[Element], list[Block]]:
    """The page's elements, parents first, and its non-empty blocks in order, whatever they are."""
    root = Element("html", 0, None, 0)
    at, out, elements = root, [], [root]
    paths: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    links, linked = 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(at, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    for tag, closing, rest in _events(page):
        if not tag:
            parts.append(rest)
            if links:
                linked += len(rest)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        close()
        links = 0
        if tag in VOID:
            continue
        if closing:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if tag == "html":
            continue
        if tag in PARAGRAPH_ENDS:
            at = _leave(at, ("p",), ("article", "main", "section", "div", "td", "th", "li", "body", "table"))
        if tag in HEADINGS and at.tag in HEADINGS:
            at = at.parent
        elif tag == "li":
            at = _leave(at, ("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            at = _leave(at, ("dt", "dd"), ("dl",))
        elif tag in ("tr", "td", "th"):
            at = _leave(at, ("td", "th") if tag != "tr" else ("tr",), ("table",) if tag == "tr" else ("tr", "table"))
        elif tag == "option":
            at = _leave(at, ("option",), ())
        elif tag == "body":
            at = _leave(at, ("head",), ())
        if at.depth >= DEPTH:
            at = at.parent
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}
        classes = ".".join(sorted(found.get("class", "").split()))
        path = paths.setdefault((at.path, f"{tag}.{classes}" if classes else tag), len(paths) + 1)
        at = Element(tag, path, at, _veto(tag, found, at))
        elements.append(at)
    close()
    return elements, out


def _leave(at: Element, tags: tuple[str, ...], bounds: tuple[str, ...]) -> Element:
    """Close an open element of `tags`, unless one of `bounds` stands between."""
    up = at
    while up.parent is not None and up.tag not in bounds:
        if up.tag in tags:
            return up.parent
        up = up.parent
    return at


def path_ratios(found: list[Block]) -> dict[int, float]:
    """Each path's fused ratio: mean text length and punctuation, each times its standard deviation, as parts of a layout are few and alike and those of a text differ."""
    sums: dict[int, list[float]] = {}
    for b in found:
        chars, marks = len(b.text) - b.linked, len(_PUNCTUATION.findall(b.text))
        s = sums.setdefault(b.element.path, [0, 0, 0, 0, 0])
        for k, x in enumerate((1, chars, marks, chars * chars, marks * marks)):
            s[k] += x
    return {path: chars / n * (1 + marks / n) * (1 + _deviation(n, chars, chars2)) * (1 + _deviation(n, marks, marks2)) for path, (n, chars, marks, chars2, marks2) in sums.items()}


def _deviation(n: int, total: int, squares: int) -> float:
    return math.sqrt(max(0, squares * n - total * total)) / n


def path_levels(found: list[Block]) -> dict[int, float]:
    """Each path's level: the logarithm of its ratio, smoothed along the page."""
    ratios = path_ratios(found)
    paths = [b.element.path for b in found]
    own = np.log1p([ratios[p] for p in paths])
    padded = np.concatenate([own[:1], own, own[-1:]])
    smooth = (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4
    fused: dict[int, list[float]] = {}
    for path, value in zip(paths, smooth):
        fused.setdefault(path, []).append(float(value))
    return {path: sum(v) / len(v) for path, v in fused.items()}


def main_text(page: str | None, strength: float = STRENGTH) -> str:
    """The main text of a page, one block a line; empty if there is none. strength: how far up from the least level to the greatest a path has to be, 0 to 1."""
    if not 0 <= strength <= 1:
        raise ValueError("strength is 0 to 1")
    elements, found = blocks(page or "")
    if not any(b.element.veto != CERTAIN for b in found):
        return ""
    levels = path_levels(found)
    level = [levels[b.element.path] for b in found]
    least = min(level)

    def high(of: list[bool]) -> list[bool]:
        """Which blocks are high, by the greatest level among the blocks of `of`."""
        top = max(x for x, fits in zip(level, of) if fits)
        return [x >= least + strength * (top - least) for x in level]

    likely = [b.element.veto != CERTAIN for b in found]
    at_home = [x and b.element.in_home for x, b in zip(likely, found)]
    named = [x and not b.element.away for x, b in zip(at_home, found)]
    judge(elements, found, high(named if any(named) else at_home if any(at_home) else likely))
    fit = [not b.element.away for b in found]
    if not any(fit):
        return ""
    at_home = [f and b.element.in_home for f, b in zip(fit, found)]
    chosen = [f and h for f, h in zip(fit, high(at_home if any(at_home) else fit))]
    for b, c in zip(found, chosen):
        if c:
            b.element.mass += len(b.text) - b.linked
    for e in reversed(elements[1:]):
        e.parent.mass += e.mass
    return "\n".join(b.text for b, k in zip(found, _kept(found, chosen, _home(elements))) if k)


def _kept(found: list[Block], chosen: list[bool], home: Element) -> list[bool]:
    """The chosen blocks; of the others headings right before a kept block and parts of a text that stand beside chosen ones.

    Blocks that are mostly links need a chosen block before and after, and the content's element around. Elements that are never main text have none.
    """
    e, above = home, set()
    while e is not None:
        above.add(e)
        e = e.parent
    within: dict[Element, bool] = {}

    def inside(e: Element) -> bool:
        way = []
        while e not in within and e is not home and e not in above:
            way.append(e)
            e = e.parent
        known = e is home or within.get(e, False)
        within.update((x, known) for x in way)
        return known

    def host(e: Element) -> Element:
        """The element that the text is a part of, beyond lists, tables and quotes."""
        while e.tag in STRUCTURE and e.parent is not None:
            e = e.parent
        return e

    hosts = {host(b.element) for b, c in zip(found, chosen) if c}
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    whole = home.tag not in ("html", "body")
    kept = list(chosen)
    for k in reversed(range(len(found))):
        b = found[k]
        if chosen[k] or b.element.away:
            continue
        between, held = first < k < last, whole and inside(b.element)
        if 2 * b.linked > len(b.text):
            kept[k] = between and held
        else:
            kept[k] = ((between or held) and host(b.element) in hosts) or (b.element.tag in HEADINGS and k + 1 < len(found) and kept[k + 1])
    return kept


def _home(elements: list[Element]) -> Element:
    """The element that holds the content: an article or main with most of the selected text, else the deepest element that does."""
    at = elements[0]
    while at.tag not in HOME:
        best = max((c for c in at.children if not c.away), key=lambda c: c.mass, default=None)
        if best is None or best.tag in LEAVES or best.mass < 0.6 * at.mass or best.mass == 0:
            break
        at = best
    if at.tag == "main":  # an article inside holds the text without what stands beside it
        for e in elements:
            e.inside = e is at or (e.parent is not None and e.parent.inside)
        return next((e for e in elements if e.inside and e.tag == "article" and not e.away and e.mass >= 0.8 * at.mass), at)
    return at


def extract(pages: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    text: the main text with character references decoded, white space in a block
    turned into one space, blocks in page order joined by one newline; empty for null or empty html and pages without main text.
    n_chars: its code points. Text without any tag is a block of its own. Repeats and nulls are kept; other columns are ignored, of any
    name. Very long and broken pages take time in proportion to their length; a tag that is never closed is text.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), strength) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
