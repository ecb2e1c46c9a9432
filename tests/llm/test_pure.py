import re
import time

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathom.llm import bpe, fingerprint, html_text, line_dedup, ngram_join, packing


def test_bpe_equals_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.Codec(path)
    for text in ["", "a", "aaaa aaaaaaa", "  x\n\n y ", "<|endoftext|>hi<|endoftext|>", "½²", "日本 🙂"]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ",".join(map(str, ids))
        assert ours.decode(ours.encode(text)) == theirs.decode(ids, skip_special_tokens=False)


def test_words_split_alike_around_every_code_point():
    """A letter, a digit and a mark before each code point tell its class; blanks are told by the mark before them."""
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for lo in range(0, len(points), 20_000):
        text = "".join(f"a{c}1{c}!{c}" for c in points[lo : lo + 20_000])
        ends = [b for _, (_, b) in theirs.pre_tokenize_str(text)]
        at, ours = 0, []
        for word in bpe.split_words(text):
            at += len(word)
            ours.append(at)
        assert ours == ends


def test_packing_encodes_as_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), packing.encoder(path)
    blanks = " \n\t" * 400_000
    unassigned = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in (0x558, 0x88F, 0x11DB0, 0x323B0, 0x3FC3F))
    for text in ["", "it's 12  x", blanks, blanks + "y", f"a\u3000{blanks} b<|endoftext|>{blanks}", "ab" * 200_000, "!" * 300_000, unassigned]:
        assert ours(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_linked_sets_share_a_route():
    rng = np.random.default_rng(3)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    for n in (1, 5, 9, 30, 200, 900):
        base = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        other = np.unique(np.append(base[: -(n // 10) or None], rng.integers(1, 2**63, n // 10, dtype=np.uint64)))
        overlap = len(np.intersect1d(base, other))
        if ngram_join.linked(overlap, len(base), len(other), 80):
            mine, theirs = (dict(ngram_join.routes(h, 80, none)) for h in (base, other))
            assert any(len(np.intersect1d(mine[k], theirs[k])) for k in mine.keys() & theirs.keys())
            larger = max(len(base), len(other))  # they meet in the class of the larger one
            assert max(ngram_join.classes_of(min(len(base), len(other)), 80)) >= ngram_join.classes_of(larger, 80)[0]


def test_words_that_differ_have_other_hashes():
    a = "a"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})  # Thue-Morse words collide under any polynomial modulo a power of two
    assert len(np.union1d(ngram_join.shingles(a), ngram_join.shingles(a.translate({97: 98, 98: 97})))) == 2
    for text, n in (("a b c d e", 1), ("a b c d e f", 2), ("a b c d", 1), ("A  b\tc d", 1), ("a b c d e a b c d e a", 5)):
        assert len(ngram_join.shingles(text)) == n
    assert ngram_join.shingles("A  b\tc d").tolist() == ngram_join.shingles("a b c d").tolist()
    assert len({ngram_join.shingles(t)[0] for t in ("a", "a a", "a a a", "a a a a", "a a a a a", "b a", "a b")}) == 7


def brute_parts(sets, left, right, percent, parts):
    up = list(range(len(sets)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    first = {}
    for k, p in enumerate(parts):
        up[find(k)] = find(first.setdefault(p, k))
    for a in range(len(sets)):
        for b in range(len(sets)):
            if left[a] and right[b] and a != b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def test_block_links_connect_what_all_links_connect():
    rng = np.random.default_rng(5)
    for trial in range(40):
        base = [set(rng.integers(0, 400, rng.integers(1, 60)).tolist()) for _ in range(6)]
        sets = []
        for _ in range(40):
            mine = set(base[rng.integers(6)])
            for g in rng.integers(0, 400, rng.integers(0, 8)).tolist():
                mine ^= {g}
            sets.append(mine or {1})
        own = trial % 2 == 0
        left = [True] * 40 if own else (rng.random(40) < 0.4).tolist()
        right = [True] * 40 if own else [x or not y for x, y in zip((rng.random(40) < 0.5).tolist(), left)]
        parts = list(range(40)) if trial % 3 else [int(x) for x in rng.integers(0, 30, 40)]
        arrays = [np.array(sorted(x), np.uint64) for x in sets]
        found = list(ngram_join.block_links(arrays, parts, left, right, 80))
        for a, b, overlap in found:
            assert overlap == len(sets[a] & sets[b]) and ngram_join.linked(overlap, len(sets[a]), len(sets[b]), 80)
        want = brute_parts(sets, left, right, 80, parts)
        alone = [False] * 40
        got = brute_parts([set(x) for x in sets], alone, alone, 80, parts)
        up = {k: k for k in range(40)}

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for k, g in enumerate(got):
            up[find(k)] = find(g)
        for a, b, _ in found:
            up[find(a)] = find(b)
        assert len({(w, find(k)) for k, w in enumerate(want)}) == len(set(want)) == len({find(k) for k in range(40)})


def test_packing_fits_and_loses_nothing():
    sizes = np.random.default_rng(1).integers(1, 257, 300).tolist()
    dealt = packing.pack(sizes, 1024)
    assert sorted(i for part in dealt for i in part) == list(range(300))
    assert max(sum(sizes[i] for i in part) for part in dealt) <= 1024


def test_cuckoo_filter_deletes():
    f = line_dedup.CuckooFilter(8)
    keys = [int(k) for k in np.random.default_rng(2).integers(0, 2**63, 3000)]
    for k in keys:
        f.insert(k)
    assert all(k in f for k in keys)
    assert all(f.delete(k) for k in keys) and f.count == 0


def test_cuckoo_filter_grows_and_then_deletes():
    """Deleting a key takes no other key away, at any size, also where prints and low bits are the same."""
    f = line_dedup.CuckooFilter(8)
    a, b = 0xABCD << 48 | 3, 0xABCD << 48 | 0x13
    f.insert(a)
    for k in range(200):
        f.insert(k << 40 | k)
    f.insert(b)
    assert f.grown and f.delete(b) and a in f
    rng = np.random.default_rng(4)
    f, live = line_dedup.CuckooFilter(8), []
    for step in range(60_000):
        if live and rng.random() < 0.4:
            assert f.delete(live.pop(int(rng.integers(len(live)))))
        else:
            live.append(int(rng.integers(0, 1 << 16)) << 48 | int(rng.integers(0, 1 << 14)))  # prints and buckets clash
            f.insert(live[-1])
        if step % 10_000 == 0:
            assert all(k in f for k in live)
    assert f.count == len(live) and all(k in f for k in live)
    assert all(f.delete(k) for k in live) and not any(f.table)
    for _ in range(30):
        f.insert(a)
    assert f.count == 30 and all(a in f and f.delete(a) for _ in range(30)) and a not in f and not f.more


def test_fingerprints_and_html():
    assert fingerprint.sketches(["", "abc", "abc"])[1] == fingerprint.sketches(["abc"])[0]
    assert html_text.main_text("<body><nav>x</nav><article><h1>T</h1><p>a, b &amp; c.</article>") == "T\na, b & c."
    assert html_text.main_text(None) == ""


SENTENCE = "This is a sentence, with some words in it; and more. "


def test_html_keeps_selected_text_beside_the_container():
    long = "".join(f"<p>{k} {SENTENCE * 3}</p>" for k in range(5))
    lines = [f"{k} {SENTENCE * 3}".strip() for k in range(5)]
    menu = "<nav><a href=x>Menu</a></nav>"
    got = html_text.main_text(f"<body>{menu}<h1>Title</h1><div class=post><p>intro, {SENTENCE}</p><div class=text>{long}</div></div></body>")
    assert got.split("\n") == ["Title", f"intro, {SENTENCE}".strip(), *lines]
    split = "".join(f"<p>end {k} {SENTENCE * 3}</p>" for k in range(3))
    got = html_text.main_text(f"<body>{menu}<div class=a>{long}</div><div class=b>{split}</div></body>")
    assert got.split("\n") == [*lines, *(f"end {k} {SENTENCE * 3}".strip() for k in range(3))]
    got = html_text.main_text(f"<body>{menu}<h1>Title</h1>{long}<h2>Part</h2>{split}</body>")
    assert got.split("\n") == ["Title", *lines, "Part", *(f"end {k} {SENTENCE * 3}".strip() for k in range(3))]
    tags = "<ul><li><a href=x>red</a></li><li><a href=y>blue</a></li></ul>"
    got = html_text.main_text(f"<body><article>{long}{tags}</article></body>")  # links alone have no ratio, in an article as elsewhere
    assert got.split("\n") == lines


def test_html_words_do_not_veto_what_holds_the_text():
    long = "".join(f"<p>{k} {SENTENCE * 3}</p>" for k in range(5))
    text = "\n".join(f"{k} {SENTENCE * 3}".strip() for k in range(5))
    menu, side = "<nav><a href=x>Menu</a></nav>", f"<div class=sidebar><p>Side, {SENTENCE}</p></div><div id=main-content class='sidebar-left'><p>{SENTENCE}</p></div>"
    for wrap in ("div class='content-sidebar-wrap'", "div class='entry has-sidebar'", "div class='elementor-widget-container'", "div id='header-and-content'", "div class='post comments-open'", "form", "div class=widget", "section class='overlay banner'"):
        tag = wrap.split()[0]
        for inner in (f"<main>{long}</main>", f"<main><article>{long}</article></main>", f"<div>{long}</div>"):
            assert html_text.main_text(f"<body>{menu}<{wrap}>{inner}</{tag}>{side}</body>") == text, (wrap, inner)
    other = f"<div class=related><article><p>Other, {SENTENCE}</p></article></div><form><p>Write, {SENTENCE}</p></form><ol class=comment-list><li><article><p>Nice, {SENTENCE * 40}</p></article></li></ol>"
    assert html_text.main_text(f"<body>{menu}<article>{long}</article>{side}{other}</body>") == text
    assert html_text.main_text(f"<body><article><p>Short, {SENTENCE}</p></article><div class=ad><p>Buy, {SENTENCE * 20}</p></div></body>") == f"Short, {SENTENCE}".strip()
    assert html_text.main_text(f"<body><div class=responses>{long}</div></body>") == text
    assert html_text.main_text(f"<body><nav>{long}</nav></body>") == ""


def test_html_skips_no_more_than_the_element():
    for part in ("<svg-icon></svg-icon>", "<video-js></video-js>", "<select-menu></select-menu>", "<svg viewBox='0 0 1 1'/>", "<math/>", "<video src=x>", "<object data=x>", "<template>", "<svg><text>drawn</text></svg >", "<SVG/><svg><title>t</title><path d=''/></svg>"):
        assert html_text.main_text(f"<p>a</p>{part}<p>rest</p>") == "a\nrest", part
    assert html_text.main_text("<p>a</p><script/>x</p><p>rest</p>") == "a"
    assert html_text.main_text("<p>a</p><style>p{} </styles> x<p>rest</p>") == "a"
    assert html_text.main_text("<p>a <svg/>b <title>x</title>c</p>") == "a b c"
    assert html_text.main_text("<p>a" + "<video>" * 100_000 + "</p><p>rest</p>") == "a\nrest"


def test_bpe_table_is_deterministic_and_may_be_forgotten(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.Codec(path).automaton
    rng = np.random.default_rng(9)
    words = ["".join(chr(c) for c in rng.choice([97, 101, 115, 116, 110, 39, 233, 26085], rng.integers(1, 40))) for _ in range(300)] + ["ab" * 50_000]
    want = [[t for part in theirs.pre_tokenizer.pre_tokenize_str(w) for t in theirs.encode(w[part[1][0] : part[1][1]], add_special_tokens=False).ids] for w in words]
    got = [[t for part in bpe.split_words(w) for t in ours.encode(part.encode())] for w in words]
    assert got == want
    built = len(ours.states)
    assert [[t for part in bpe.split_words(w) for t in ours.encode(part.encode())] for w in words] == want and len(ours.states) == built  # now from the table alone
    monkeypatch.setattr(bpe, "STATES", 50)
    fresh = bpe.Codec(path).automaton
    assert [[t for part in bpe.split_words(w) for t in fresh.encode(part.encode())] for w in words] == want
    assert len(fresh.states) <= 51


def test_html_ratios_select_without_telling_names():
    """Comments, adverts and bylines in plain divs go by their paths' ratios; a list between or after paragraphs stays by its place."""
    long = "".join(f"<p>{k} {SENTENCE * 4}</p>" for k in range(6))
    lines = [f"{k} {SENTENCE * 4}".strip() for k in range(6)]
    menu = "<nav><a href=x>Menu</a></nav>"
    box = "<div><h3>3 thoughts</h3><div><b>Bob</b> Nice one</div><div><b>Eve</b> I agree</div><div><b>Al</b> Me too</div></div>"
    advert = "<div>Buy now</div>"
    items = "<ul><li>red ones</li><li>blue ones</li></ul>"
    page = f"<body>{menu}<article><h1>Title</h1>{long}{advert}{items}{long}{box}</article></body>"
    assert html_text.main_text(page).split("\n") == ["Title", *lines, "red ones", "blue ones", *lines]
    loose = html_text.main_text(page, strength=0.0)
    assert "Buy now" in loose and "Nice one" in loose and len(loose) > len(html_text.main_text(page))  # the ratios decide
    flat = f"<body>{menu}<div>{long}{items}</div>{advert}<div><div>Older</div><div>Newer</div></div></body>"
    assert html_text.main_text(flat).split("\n") == [*lines, "red ones", "blue ones"]
    science = f"<body><article><section id=methods><h2>Methods</h2>{long}</section><section id=discussion><h2>Discussion</h2>{long}</section></article></body>"
    assert html_text.main_text(science).split("\n") == ["Methods", *lines, "Discussion", *lines]


def test_html_ratios_equal_a_plain_count():
    page = f"<body><div class='b a'><p>One, two.</p><p>Three <a href=x>four</a>!</p></div><p>Five</p><table><tr><td>{SENTENCE}</td></tr></table></body>"
    _, found = html_text.blocks(page)
    texts = {"p in div": ["One, two.", "Three four!"], "p": ["Five"], "td": [SENTENCE.strip()]}
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    want = []
    for name, held in texts.items():
        chars = sum(map(len, held)) - (4 if name == "p in div" else 0)  # four stands in a link
        own = [len(t) - (4 if t.startswith("Three") else 0) for t in held]
        want.append(chars / len(held) * (1 + sum(map(marks, held)) / len(held)) * (1 + np.std(own)) * (1 + np.std([marks(t) for t in held])))
    assert np.allclose(sorted(html_text.path_ratios(found).values()), sorted(want))
    own = np.log1p([want[0], want[0], want[1], want[2]])
    smooth = [(a + 2 * b + c) / 4 for a, b, c in zip([own[0], *own], own, [*own[1:], own[-1]])]
    assert np.allclose(sorted(html_text.path_levels(found).values()), sorted([(smooth[0] + smooth[1]) / 2, smooth[2], smooth[3]]))


def test_html_ratios_select_where_names_are_hidden():
    """The pages with every telling name gone: the ratios alone find most texts as they are with names, nearly all if they are asked for more."""
    rows = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    bare = lambda h: re.sub(r'\s(class|id|role|aria-[a-z]+)="[^"]*"', "", h)
    tags = lambda h: re.sub(r"<(/?)(article|main|nav|aside|header|footer|section)\b", r"<\1div", h)
    texts = [html_text.main_text(h) for h in rows]
    same = lambda f, **more: np.mean([html_text.main_text(f(h), **more) == t for h, t in zip(rows, texts)])
    assert same(bare) >= 0.95 and same(tags) >= 0.45 and same(lambda h: tags(bare(h))) >= 0.5
    assert same(tags, strength=0.75) >= 0.85 and same(lambda h: tags(bare(h)), strength=0.75) >= 0.85
    assert same(lambda h: tags(bare(h)), strength=0.0) < 0.05, "the ratios decide"
    for strength in (-0.1, 1.1):
        with pytest.raises(ValueError):
            html_text.main_text("<p>x</p>", strength)


def test_html_broken_pages_take_linear_time():
    for bad in ("<a " * 350_000, "<svg " * 200_000, '<a "' * 250_000, "<a '" + '<b ">' * 150_000, "<!" * 300_000, "<svg>" + "</svg " * 150_000, "<ul>" + "<section>" * 20_000 + "<li></li>" * 20_000, "<" * 500_000, "<!--" * 250_000):
        began = time.time()
        html_text.main_text(bad)
        assert time.time() - began < 5, bad[:20]
    assert html_text.main_text("<p>a</p><p title='x>b</p><p>c</p>") == "a\nb\nc"
    assert html_text.main_text("x < y <b>and</b> z <3") == "x < y and z <3"
