"""The operators over small hostile tables, each against a plain brute-force version."""

import hashlib
import math
import pickle
import random
import struct
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fathom.llm import bpe, components, fingerprint, html_text, line_dedup, ngram_join, packing, queries, sharding, toxicity, url_filter, vp_tree

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, name long, root string, u string, g int, term string, _lines string, shard string, n_chars long"


def corpus(seed=5, n=60):
    """Random near copies, exact copies, shared lines, blank and null texts, one very long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ÀB", "日本", "🙂"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 20, 80]))] for _ in range(n // 3)]
    texts = [" ".join(b) for b in base]
    for b in base:
        other = list(b)
        for _ in range(rng.choice([0, 1, 2])):
            other[rng.randrange(len(other))] = rng.choice(words)
        texts.append(" ".join(other) + rng.choice(["", " tail", "\nA line that many documents share"]))
    texts += ["", "   \t\n", None, "\n", texts[0], texts[0].upper(), "x " * 30_000, "z" * 50_000, "A line that many documents share\n a LINE that many documents share \nown"]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "r", "u", 1, "t", "l", "s", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_lines(rows):
    strip = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := strip(line)) >= 20:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(strip(x), ())) >= 3 and i != max(held[strip(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_jaccard_equals_brute_force(spark, docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(corpus())
    assert ngram_join.jaccard_components(none).count() == 0
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == sorted({c for _, c in got.values()})


@pytest.mark.parametrize("kind, copies", [("near", 8), ("template", 0), ("chain", 0), ("chain", 1000)])
def test_jaccard_of_groups_larger_than_a_block(spark, monkeypatch, kind, copies):
    """Groups of several blocks: one large class and sets beside it, texts of one template without links, chains across sizes; with 0 copies, routed again."""
    for name, value in (("BLOCK_SETS", 40), ("HEAVY", 200), ("CHUNK", 4000), ("COPIES", copies)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(2)
    word = lambda n=5000: f"w{rng.randrange(n)}"
    texts = []
    if kind == "near":
        for base in ([word() for _ in range(60)] for _ in range(3)):
            for k in range(90):
                mine = list(base)
                mine[rng.randrange(60)] = word()
                texts.append(" ".join(mine + [word() for _ in range(k % 12)]))
    elif kind == "template":
        frame_ = [word() for _ in range(40)]
        for _ in range(260):
            own = [word() for _ in range(rng.choice([30, 34, 60]))]
            texts += [" ".join(frame_ + own)] + ([" ".join(frame_ + own[:-1])] if rng.random() < 0.2 else [])
    else:
        line = [word() for _ in range(500)]
        texts = [" ".join(line[a : a + 60]) for a in range(0, 400, 3)] + [" ".join(line[:n]) for n in range(20, 120)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components_equal_a_search(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 7)  # stars of a few edges only, so that rounds have work to do
    rng = random.Random(3)
    for n, m in ((40, 20), (60, 80), (300, 260)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 1), (5, 5), (2, None)]
        up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a in up and b in up and a is not None and b is not None and a != b:
                a, b = sorted((find(a), find(b)))
                up[b] = a
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
        assert got == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard_without_broadcasts(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(corpus())
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == sorted({c for _, c in got.values()})


def test_jaccard_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, "q")]
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert len(got) == 5 and {r[2] for r in got if r[1] == 2} == {3}


def test_jaccard_of_many_texts_under_one_id(spark):
    """Rows that share an id don't meet each other's texts: the work grows with the rows, not with their square."""
    rows = [(7, f"text number {k} of one and the same id {k % 50}") for k in range(3000)] + [(8, "text number 5 of one and the same id 5"), (9, "nothing else")]
    began = time.time()
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert len(got) == len(rows) and time.time() - began < 120
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (8, 7), (9, 9)}


def test_jaccard_searches_sets_of_null_ids_and_keeps_by_set(spark):
    def run(n, w="w"):
        return " ".join(f"{w}{i}" for i in range(n))

    chain = [(1, run(24)), (None, run(28)), (None, run(28)), (2, run(33))]  # 1 and 2 are linked only by way of the null id
    got = sorted(map(tuple, ngram_join.jaccard_components(frame(spark, chain)).collect()), key=str)
    assert got == sorted([(1, 20, 1), (None, 24, 1), (None, 24, 1), (2, 29, 1)], key=str)
    rows = chain + [(5, run(20, "x")), (5, run(20, "y")), (6, run(20, "p")), (6, run(25)), (7, "q"), (7, "q"), (8, ""), (8, None), (None, None)]
    rows += [(None, run(20, "n")), (None, run(21, "n")), (9, "Q r"), (9, "q R"), (3, run(20, "y") + " tail")]
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    one = [r for r in got if r[0] is None and r[1]]
    assert len(one) == 1 and one[0][1] in (run(20, "n"), run(21, "n"))
    want = [(1, run(24)), (3, run(20, "y") + " tail"), (5, run(20, "x")), (6, run(20, "p")), (7, "q"), (8, ""), (8, None), (9, "Q r"), (None, None)]
    assert [r for r in got if r not in one] == sorted(want, key=str)


def test_toxicity_takes_the_same_rows_of_repeated_ids(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'}{k} w{k}") for k in range(6) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    probes = [f"{a}{k} w{k}" for a in ("bad", "good") for k in range(6)]
    first, second = (toxicity.train(frame(spark, r), labels, bound=20) for r in (rows, rows[::-1]))
    assert [first.score(t) for t in probes] == [second.score(t) for t in probes]


def brute_line_rows(rows, none=-(2**63)):
    """Sorted (doc_id, n_lines, n_dropped, kept), one a row; rows of one doc_id, and all without one, are one document."""
    strip = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\v\f\r"))
    held, out = {}, []
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := strip(line)) >= 20:
                held.setdefault(k, set()).add(none if i is None else i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := held.get(strip(x), ())) < 3 or max(h) == (none if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


REPEATED = [(1, "one line that is long enough"), (1, "one line that is long enough"), (2, "one line that is long enough"), (None, "another line, long enough too"), (None, "another line, long enough too\nown"),
            (5, "another line, long enough too"), (6, " ANOTHER line, long enough too\nthree hold this line, says the test"), (7, "three hold this line, says the test"), (8, "three hold this line, says the test\n" * 3), (8, "three hold this line, says the test\ntail"), (None, None), (9, "")]


@pytest.mark.parametrize("bound", [None, 0])
def test_line_dedup_equals_brute_force(spark, docs, none, bound):
    for rows in (corpus(), REPEATED, corpus() + REPEATED + corpus()[:9]):
        done = line_dedup.drop_lines(frame(spark, rows), broadcast_keys=bound, into="found")
        assert [c for c in done.columns if c != "found"] == docs.columns
        got = done.select("doc_id", "found.*", "_lines").collect()
        assert {r["_lines"] for r in got} == {"l"}
        assert sorted((tuple(r)[:4] for r in got), key=str) == brute_line_rows(rows)
    clash = line_dedup.drop_lines(docs, broadcast_keys=bound)
    assert sorted(clash.columns) == sorted(docs.columns) and clash.select("_lines.kept").count() == docs.count()
    assert line_dedup.drop_lines(none, broadcast_keys=bound).count() == 0


def test_dedup_lines_keeps_the_other_columns(docs):
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(map(str, kept.drop("text", "n_chars").collect())) == sorted(map(str, docs.drop("text", "n_chars").collect()))
    want = {i: k for i, _, _, k in brute_line_rows(corpus())}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {i: (k, len(k)) for i, k in want.items()}


def test_lines_of_one_document_are_never_counted(spark):
    rows = [(i, f"this line is of document {i} alone\nand this one is of all of them") for i in range(500)]
    counted = line_dedup.counts(frame(spark, rows)).collect()
    assert max(r["docs"] for r in counted) == 500
    assert len(counted) <= 5  # the common line, and what a filter takes for seen


def test_line_index_equals_a_fresh_build(spark):
    rng, lines = random.Random(8), [f"line number {k} of those that are shared" for k in range(12)]
    text = lambda i: "\n".join(rng.sample(lines, rng.randrange(4)) + [f"the own line of document {i}"])
    index, held = line_dedup.LineIndex(spark, shards=3), {}
    for step in range(4):
        new = {i: text(i) for i in rng.sample(range(30), 12)} | ({None: text("x")} if step == 1 else {})
        index.insert(frame(spark, list(new.items())))
        held |= new
        gone = rng.sample(sorted(i for i in held if i is not None), 5) + [999] + ([None] if step == 2 else [])
        index.delete(frame(spark, [(i, None) for i in gone]))
        held = {i: t for i, t in held.items() if i not in gone}
        fresh = line_dedup.verdicts(frame(spark, list(held.items()))).collect()
        assert sorted(map(tuple, index.verdicts().collect())) == sorted(map(tuple, fresh))
    keys = {bytes(r["key"]) for r in index.counts().collect()}
    filters = [pickle.loads(r["packed"]) for r in index.filters.collect()]
    assert sum(f.count for f in filters) == len(keys) > 10
    assert all(any(int.from_bytes(k[:8], "little") in f for f in filters) for k in keys)
    index.delete(frame(spark, [(i, None) for i in held]))
    assert index.verdicts().count() == 0
    assert sum(pickle.loads(r["packed"]).count for r in index.filters.collect()) == 0


def test_bpe_round_trip(docs, none):
    theirs = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: tuple(r)[:4] for r in bpe.round_trip(docs, PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, t in corpus():
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.round_trip(none, PATH).count() == 0


def test_packing_covers_every_id_once(docs, none):
    theirs = Tokenizer.from_file(PATH)
    pieces = packing.pack_documents(docs, PATH).collect()
    ids = {i: theirs.encode(t or "", add_special_tokens=False).ids + [0] for i, t in corpus()}
    at, windows = {i: 0 for i in ids}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        mine = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(mine)
        part = mine[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        at[p["doc_id"]] += p["length"]
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert at == {i: len(x) for i, x in ids.items()}
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(windows) <= 1.1 * sum(map(len, ids.values())) / 1024 + 2
    assert packing.pack_documents(none, PATH).count() == 0


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 5).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in corpus()]
    texts = dict(corpus())
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 5)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_documents(none).count() == 0


def spark_hash(name, s):
    """xxhash64 of a string and an int, as signed 64 bits."""
    h = xxhash.xxh64(struct.pack("<i", s), seed=xxhash.xxh64(name.encode(), seed=42).intdigest()).intdigest()
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("weights", [None, [1.0, 5.0, 0.5, 2.0]])
def test_sharding_equals_brute_force(spark, weights):
    rows = [(i, f"t{i % 7}") for i in range(400)] + [(5, "t5"), (5, "t5"), (5, "other"), (None, "x"), (None, None)]

    def best(i, w):
        name = "\0null" if i is None else str(i)
        unit = lambda s: ((spark_hash(name, s) % 2**64 >> 11) + 0.5) / 2**53
        return max(range(len(w)), key=lambda s: (spark_hash(name, s) if weights is None else -w[s] / math.log(unit(s)), -s))

    own = weights or [1.0] * 4
    got = sharding.shard_documents(frame(spark, rows), 4, weights).collect()
    assert sorted((str(r["doc_id"]), r["shard"], r["grown_shard"]) for r in got) == sorted((str(i), best(i, own), best(i, [*own, sum(own) / 4])) for i, _ in rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    if weights:
        assert sum(r["shard"] == 1 for r in got) > sum(r["shard"] == 3 for r in got) > sum(r["shard"] == 2 for r in got)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), 2, [1.0, 0.0])


def check_edits(got, rows):
    """Against plain code: rows in the order of doc_id, then of the text's hash, and the next row's text."""
    def h(text):
        x = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return x - 2**64 if x >= 2**63 else x

    order = sorted(((-(2**63) if i is None else i, h(t or ""), i, t or "") for i, t in rows), reverse=True)
    want = []
    for (_, _, i, t), (*_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        prints = fingerprint.sketches([t]) + fingerprint.sketches([new]) + fingerprint.sketches([following])
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), prints[0], prints[1], fingerprint.likeness(prints[0], prints[1]), fingerprint.likeness(prints[0], prints[2])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fingerprints_of_edits(spark, docs, none):
    check_edits(fingerprint.compare_edits(docs).collect(), corpus())
    assert fingerprint.compare_edits(none).count() == 0
    check_edits(fingerprint.compare_edits(frame(spark, [(3, "only one, and itself the next")])).collect(), [(3, "only one, and itself the next")])


def test_fingerprints_with_an_id_that_many_rows_share(spark):
    rows = [(7, f"text number {k} of those with one id " * 3) for k in range(300)] + [(None, f"no id {k}") for k in range(200)] + list(enumerate(f"other {k}" for k in range(100)))
    ordered = fingerprint.in_order(frame(spark, rows).repartition(5))
    sizes = [r["count"] for r in ordered.where("not extra").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100
    check_edits(fingerprint.compare_edits(frame(spark, rows)).collect(), rows)


def test_url_rules(spark):
    urls = ["http://Example.COM/de/x?q", "https://a.example.com/de/", "http://example.com/fr/", "http://x.net", "http://x.net/", "http://www.example.net/en/a", "http://notexample.com/de/", "s://org/fr/#x", "no scheme", None, "", "a://b://c/d", "http://", "http://x.net?a/", "http://EXAMPLE.net/en/"]
    df = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate(urls)] + [(0, urls[0], "k", "h")], "page_id long, url string, key string, host string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for r in url_filter.judge(df, queries.URL_RULES).collect():
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[2], best[3]), u
    assert url_filter.judge(df, queries.URL_RULES).count() == len(urls) + 1
    assert url_filter.judge(df.where("false"), queries.URL_RULES).count() == 0


def test_url_rules_by_brute_force(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "com", "net"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["x", "y", ""]) for _ in range(rng.randint(0, 3)))
    rules = [url_filter.Rule(rng.choice(["block", "allow"]), host(), path()) for _ in range(60)]
    urls = [f"http://{host()}{path()}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, lanes=3).collect()}
    for i, u in enumerate(urls):
        h, _, p = u[7:].partition("/")
        fits = [(len(r.host), len(r.path), r.verdict, r.host + r.path) for r in rules if (h == r.host or h.endswith("." + r.host)) and ("/" + p).startswith(r.path)]
        best = max(fits, default=(0, 0, "allow", None))
        assert got[i] == (best[3], best[2])


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>Some text, here.</p></article>" * 2, "x"), (3, "u", "<p", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=str) == sorted([(1, "u", ""), (2, None, ""), (3, "u", "Some text, here.\nSome text, here."), (3, "u", "<p")], key=str)
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.where("false")).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(600)]
    data += [(600, None, 0), (601, [0.0] * 8, 0), (602, [float("nan")] + [1.0] * 7, 0), (603, data[0][1], 0), (604, data[0][1], 0), (605, [None] + [1.0] * 7, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    m = {i: np.asarray(v, np.float32).astype(np.float64) for i, v, _ in data if i < 600 or i in (603, 604)}

    def found(relax):
        out = {}
        for r in vp_tree.nearest(df, F.col("vec_id") % 100 == 0, 10, relax, shard=150 * 8).collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        return {q: [(s, v) for _, s, v in sorted(x)] for q, x in out.items()}

    want = {q: sorted((float(np.sqrt(((m[q] - m[i]) ** 2).sum())), i) for i in m if i != q)[:10] for q in m if q % 100 == 0}
    exact = found(1.0)
    assert {q: [v for _, v in x] for q, x in exact.items()} == {q: [v for _, v in x] for q, x in want.items()}
    for q, x in exact.items():
        assert np.allclose([s for s, _ in x], [s for s, _ in want[q]], rtol=1e-12)
    relaxed = found(queries.RELAX)
    assert np.mean([len({v for _, v in relaxed[q]} & {v for _, v in want[q]}) / 10 for q in want]) >= 0.9
    assert vp_tree.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """Rows of one id with other vectors are rows like any other, as candidates and as queries."""
    rows = [(100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [5.0, 5.0]), (2, [0.0, 3.0])]
    got = vp_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.rank, r.vec_id, round(r.score, 3)) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 2.0), (3, 1, 6.403)]
    twice = spark.createDataFrame([*rows, (100, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = vp_tree.nearest(twice, F.col("vec_id") % 100 == 0, 1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 3)) for r in got) == [(100, 1, 1, 1.0), (100, 1, 1, 5.657)]


@pytest.mark.parametrize("shard", [vp_tree.SHARD, 300 * 64])
def test_nearest_recall_against_its_sql(spark, shard):
    folder, db = "/root/testdata/sf0.1", duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = {(query, vec) for query, _, vec, _ in db.execute(queries.OP9_SQL).fetchall()}
    table = queries.table(spark, folder, "embeddings")
    got = {(r["query_id"], r["vec_id"]) for r in vp_tree.nearest(table, F.col("vec_id") % 100 == 0, 10, queries.RELAX, shard).collect()}
    assert len(want) == 200 and len(got & want) >= 0.9 * 200
    exact = {(r["query_id"], r["vec_id"]) for r in vp_tree.nearest(table, F.col("vec_id") % 100 == 0, 10, 1.0, shard).collect()}
    assert exact == want


def test_tree_is_exact_with_ties_and_repeats():
    rng = np.random.default_rng(6)
    for dims, n in ((1, 900), (2, 700), (5, 3000)):
        points = np.round(rng.normal(size=(n, dims)), 1).astype(np.float32)
        points[: n // 3] = points[0]  # a third are one vector
        ids = rng.permutation(n).astype(np.int64)
        tree = vp_tree.VpTree(ids, points, leaf=16)
        asked = rng.choice(n, 60, replace=False)
        d, found = tree.search(points[asked], ids[asked], 10)
        for row, at in enumerate(asked):
            exact = np.sqrt(((points.astype(float) - points[at].astype(float)) ** 2).sum(1))
            want = sorted((x, i) for x, i in zip(exact.tolist(), ids.tolist()) if i != ids[at])[:10]
            assert list(zip(d[row].tolist(), found[row].tolist())) == want
    few = vp_tree.VpTree(np.array([4, 7]), np.array([[1.0], [2.0]]))
    assert few.search(np.array([[1.0]]), np.array([4]), 3)[1].tolist() == [[7, vp_tree._NO_ID, vp_tree._NO_ID]]


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, folder).join(queries.table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.95 and hit / got.toxic.sum() > 0.8


def test_toxicity_learns_a_pair():
    rng = random.Random(3)
    fill = lambda: " ".join(rng.choices([f"f{i}" for i in range(50)], k=8))
    texts = [(f"{a} {b} {fill()}", int(a == "dumb" and b == "people")) for a in ("dumb", "nice") for b in ("people", "idea") for _ in range(150)]
    machine = toxicity.fit([toxicity.terms(t) for t, _ in texts], [y for _, y in texts])
    scores = {pair: machine.score(" ".join(pair)) for pair in [("dumb", "people"), ("dumb", "idea"), ("nice", "people")]}
    assert scores.pop(("dumb", "people")) > 0.8 and max(scores.values()) < 0.3


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for few in (labels, labels.where("false")):
        machine = toxicity.train(docs, few)
        scores = [r["_score"] for r in toxicity.scored(docs, machine).collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_clean(none, labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    asked = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in asked.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, asked.fetchall()))


def test_pipeline_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    table = queries.table(spark, folder, "documents")
    machine = toxicity.train(table, queries.table(spark, folder, "labels"))
    rows = [(r["doc_id"], r["text"]) for r in table.collect() if machine.score(r["text"]) < 0.3]
    cut = brute_lines(rows)
    rows = [(i, cut[i][2]) for i, _ in rows]
    place = brute_components(rows)
    rows = [(i, t) for i, t in rows if place[i][1] == i]
    theirs = Tokenizer.from_file(PATH)
    want = {i: len(theirs.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    got = {}
    for p in corpus_pipeline.run(spark, folder).collect():
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == want and 0 < len(want) < table.count()


def test_bpe_documents_there_and_back(docs, none):
    theirs = Tokenizer.from_file(PATH)
    ids = bpe.encode_documents(docs, PATH)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t in corpus()}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, PATH).collect()} == {i: t or "" for i, t in corpus()}
    assert bpe.encode_documents(none, PATH).count() == 0 and bpe.decode_documents(bpe.encode_documents(none, PATH), PATH).count() == 0


def test_toxicity_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    buckets = np.unique(np.concatenate([toxicity.terms(f"t{k}") for k in range(40)]))
    machine = toxicity.Machine(buckets, 0.3, rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), 4)))
    for text in ("t1 t2 t3", "T5 t5, t7!", "unknown words", "", None, " ".join(f"t{k}" for k in range(40))):
        at = [int(np.searchsorted(buckets, t)) for t in toxicity.terms(text) if t in set(buckets.tolist())]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(machine.score(text) - 1 / (1 + math.exp(-min(30, max(-30, z))))) < 1e-9


def test_score_and_lines_don_t_take_the_place_of_columns(spark):
    rows = [(i, f"words {i % 5} of document", "mine", 7.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lines string, _score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    for kept in (toxicity.keep_clean(df, labels), line_dedup.dedup_lines(df), ngram_join.keep_one(df)):
        assert kept.columns == df.columns and {(r["_lines"], r["_score"]) for r in kept.collect()} <= {("mine", 7.0)}


def test_likeness_of_sketches():
    rng = random.Random(1)
    words = [f"word{rng.randrange(900)}" for _ in range(400)]
    text, other = " ".join(words), " ".join(f"other{rng.randrange(900)}" for _ in range(400))
    a, b, shifted, half = fingerprint.sketches([text, other, "a prefix of some length " + text, text[: len(text) // 2] + other[: len(other) // 2]])
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, "") == 0 and fingerprint.likeness("", "") == 1
    assert fingerprint.likeness(a, shifted) > 0.8 > fingerprint.likeness(a, half) > 0.2 > fingerprint.likeness(a, b)

    def brute(x, y):
        total = 0.0
        for (_, k, weight), p, q in zip(fingerprint.LEVELS, x.split("-"), y.split("-")):
            left, right = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (p, q))
            least = sorted(left | right)[:k]
            j = len([v for v in least if v in left and v in right]) / len(least)
            total += weight * 2 * j / (1 + j)
        return total / sum(w for *_, w in fingerprint.LEVELS)

    for x, y in ((a, b), (a, half), (shifted, half)):
        assert abs(fingerprint.likeness(x, y) - brute(x, y)) < 1e-12


def test_fingerprint_rows(docs, none):
    got = {r["doc_id"]: (r["n_chars"], r["fingerprint"]) for r in fingerprint.fingerprints(docs).collect()}
    assert got == {i: (len(t or ""), fingerprint.sketches([t or ""])[0]) for i, t in corpus()}
    assert fingerprint.fingerprints(none).count() == 0


def test_pipeline_stages_on_hostile_documents(spark, tmp_path):
    """Nulls, blanks, repeats and columns with clashing names go through all stages; so does an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _lines string, _score double, root long, name string"
    held = [(i, t, "en", "s", None if t is None else len(t), "l", 1.0, 5, "n") for i, t in corpus()] + [(None, None, None, None, None, None, None, None, None), (3, "again, another text", "en", "s", 19, "l", 1.0, 5, "n")]
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (held, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            assert docs.columns == before.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (pieces.count() > 0) == bool(rows)


def test_join_holds_one_python_worker_a_core(spark, monkeypatch):
    """Ties are read from where they were written: two Python steps in one stage would hold two workers for every core."""
    plans = []
    inner = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or inner(edges))
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k // 2}") for k in range(8)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert found == {k: k // 2 * 2 for k in range(8)}
    assert plans and not any("MapInArrow" in p for p in plans)
