import datetime as dt
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from fathom.functions import json, params, text
from fathom.operators import retrieval, sessions, state, structure
from fathom.sources import tables
from fathom.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.fixture(scope="module")
def pool(spark):
    """12 of A from .99 down, 4 of B from .60, 4 of C from .40."""
    data = [(i, "A", 0.99 - 0.01 * i) for i in range(12)] + [(20 + i, "B", 0.6 - 0.01 * i) for i in range(4)] + [(30 + i, "C", 0.4 - 0.01 * i) for i in range(4)]
    return spark.createDataFrame(data, "item long, source string, score double")


def shares(df):
    return dict(df.groupBy("source").count().collect())


def test_source_limits(pool):
    limit = lambda **k: retrieval.source_limits(pool, "source", "item", 8, **k)
    assert shares(limit()) == {"A": 8}
    assert shares(limit(most=3)) == {"A": 3, "B": 3, "C": 2}
    assert shares(limit(least=1)) == {"A": 6, "B": 1, "C": 1}
    assert shares(retrieval.source_limits(pool, "source", "item", 20, most=2)) == {"A": 2, "B": 2, "C": 2}
    assert shares(retrieval.source_limits(pool, "source", "item", 2, least=1)) == {"A": 1, "B": 1}


def test_floor_keeps_main_and_scores_below(pool):
    main = retrieval.top(pool, "item", 5)
    got = {r["item"]: (r["source_floor"], r["score"]) for r in retrieval.with_floor(main, pool.where("item in (0, 20, 30)"), "item").collect()}
    assert len(got) == 7 and got[0] == (False, 0.99)
    assert got[20] == (True, pytest.approx(0.94)) and got[30] == (True, pytest.approx(0.93))


def test_fusion_is_symmetric_and_complete(pool):
    a, b = pool.where("source = 'A'"), pool.where("score < 0.9")
    assert rows(retrieval.fused(a, b, "item")) == rows(retrieval.fused(b, a, "item"))
    assert rows(retrieval.fused(a, b.where("false"), "item", weight=1.0))[0] == (0, round(1 / 61, 6))


def test_budget_is_a_prefix(spark):
    r = spark.createDataFrame([(1, "s", 0.9, "x" * 40), (2, "s", 0.8, "x" * 400), (3, "t", 0.7, "x" * 4), (4, None, 0.6, None)], "item long, source string, score double, body string")
    kept = lambda limit, header=0: [x[0] for x in rows(retrieval.within_budget(r, "item", "source", "body", limit, header).select("item"))]
    assert kept(10) == [1] and kept(9) == [] and kept(110) == [1, 2] and kept(None) == [1, 2, 3, 4] == kept(0)
    assert kept(10, header=1) == []


def test_bm25_without_matches_or_rows(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, None), (3, "")], "id long, body string")
    assert retrieval.bm25(docs, "id", "body", ["zebra"]).count() == 0
    assert retrieval.bm25(docs, "id", "body", []).count() == 0
    assert retrieval.bm25(docs.where("false"), "id", "body", ["fox"]).count() == 0
    assert [r[0] for r in rows(retrieval.bm25(docs, "id", "body", ["fox"]).select("id"))] == [1]


def test_chunks_cover_the_text(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choices("ab\n", k=n))) for i, n in enumerate([0, 1, 9, 10, 11, 19, 20, 21, 55])] + [(99, None)]
    df = spark.createDataFrame(docs, "id long, body string")
    got = {}
    for i, k, start, piece in rows(structure.chunks(df, "id", "body", 10, 2)):
        assert start == 8 * k and len(piece) <= 10
        got[i] = got.get(i, "")[:start] + piece
    assert got == {i: t for i, t in docs if t}


def test_sliding_window_equals_brute_force(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    data = [(i, rng.choice("abc"), start + dt.timedelta(seconds=rng.randrange(600))) for i in range(300)]
    df = spark.createDataFrame(data, "id long, who string, at timestamp_ntz")
    for limit in (1, 2, 5):
        want, held = [], {}
        for i, who, at in sorted(data, key=lambda r: (r[1], r[2], r[0])):
            inside = [t for t in held.get(who, []) if (at - t).total_seconds() < 60]
            held[who] = inside + [at] if len(inside) < limit else inside
            want.append((who, i, len(inside) < limit))
        assert rows(state.sliding_window(df, "who", "at", "id", limit, 60)) == sorted(want)


def test_transitions(spark):
    runs = spark.createDataFrame([(1, "pending", 0, None), (2, "indexing", 1, "gone"), (3, "indexing", 3, "gone"), (4, "indexing", 3, "here"), (5, "indexed", 1, None)], "id long, status string, attempts int, owner string")
    claimed = state.claimed(runs, "me")
    assert rows(claimed.select("id", "status", "attempts", "owner"))[0] == (1, "indexing", 1, "me")
    assert rows(state.claimed(claimed, "you").where("owner = 'you'")) == []
    assert rows(state.finished(claimed, "me", "indexed").where("status = 'indexed'").select("id")) == [(1,), (5,)]
    alive = spark.createDataFrame([("here",), ("here",)], "owner string")
    assert rows(state.recovered(runs, alive).select("id", "status")) == [(1, "pending"), (2, "pending"), (3, "failed"), (4, "indexing"), (5, "indexed")]
    assert rows(state.upserted(runs, runs.where("id = 5").withColumn("attempts", F.lit(9)), "id").where("id = 5").select("attempts")) == [(9,)]


def test_history_starts_with_a_user(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", " "), (2, 0, "assistant", "x")], "c long, t long, role string, text string")
    assert rows(sessions.trailing_history(m, "c", "t", 2).select("c", "t")) == [(1, 3)]
    assert rows(sessions.misplaced(m, "c", "t").select("c", "t")) == [(1, 3), (2, 0)]


def test_text(spark):
    assert one(spark, "a [1] b [3][1].", text.citations) == ["1", "3"]
    assert one(spark, "a [1] b [3][1].", text.without_citations) == "a b."
    assert one(spark, "# Big\n**bold** [l](u) `c`", text.plain_text) == "Big\nbold l c"
    assert one(spark, "x\n# The title \n", lambda c: text.document_title(c, F.lit("f"))) == "The title"
    assert one(spark, "x" * 201, text.shortened) == "x" * 197 + "..."
    assert one(spark, "100% A_B", lambda c: text.contains_literal(c, "% a_b")) is True
    assert one(spark, "yes", lambda c: json.coerced(c, "boolean")) is True
    assert one(spark, '{"a": "1", "b": ""}', lambda c: json.as_int(json.field(c, "b"))) is None


def test_urls(spark):
    for given, wanted in [("https://a.b/c/#x", "https://a.b/c"), ("https://a.b", "https://a.b/"), ("https://a.b/", "https://a.b/")]:
        assert one(spark, given, tables.normalized_url) == wanted
    assert [one(spark, u, tables.valid_url) for u in ("http://a", "ftp://a", "http://", None)] == [True, False, False, False]
    for private in ("http://127.0.0.1/x", "http://localhost:80", "https://10.1.2.3", "http://192.168.0.9/", "http://172.20.0.1", "http://[::1]/", "http://169.254.169.254/latest", "http://u@0.0.0.0/", "http://[fd00::1]"):
        assert one(spark, private, tables.valid_url) is False, private
    for public in ("http://172.32.0.1", "http://11.0.0.1", "http://localhost.example.com", "http://a.b:8080/x"):
        assert one(spark, public, tables.valid_url) is True, public


def test_links_resolve_as_the_standard_library_does(spark):
    bases = ["http://x.org/a/c.html", "http://x.org", "http://x.org/a/b/", "https://x.org/a?q=/z/y", "http://x.org/a/../b/c"]
    hrefs = ["b.html", "//cdn.y.org/z", "../up", "../../../up/", "/root/./p", "?q=1", ".", "..", "./k/../m", "http://z.org/p", "mailto:a@b.c", "x?y=../z", "a/b/../..", "b;p"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", tables.absolute_url(F.col("b"), F.col("h")).alias("u")).collect()
    for r in got:
        want = urljoin(r["b"] if "/" in r["b"][8:] else r["b"] + "/", r["h"])
        assert r["u"] == want, (r["b"], r["h"], r["u"], want)
    page = spark.createDataFrame([(1, "http://x.org/a/c.html", '<a href="b.html">1</a><A class=k HREF=\'../a/b.html\'>2</a><a href="/s?x=1&amp;y=2">3</a><a href="mailto:q@r.s"></a><a href="#top"></a><a href="//cdn.y.org"></a>')], "page_id long, url string, html string")
    assert [r["link"] for r in tables.links(page).orderBy("position").collect()] == ["http://x.org/a/b.html", "http://x.org/s?x=1&y=2", "http://cdn.y.org/"]


def test_sitemaps_end_in_loops_and_depth(spark):
    url = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    maps = [("root", f"<sitemapindex>{url('a', 'b', 'root')}</sitemapindex>"), ("a", f"<urlset>{url('p1', 'p2')}</urlset>"), ("b", f"<sitemapindex>{url('c')}</sitemapindex>"), ("c", f"<urlset>{url('p2', 'p3')}</urlset>"), ("lost", f"<urlset>{url('p9')}</urlset>")]
    df = spark.createDataFrame(maps, "loc string, xml string")
    assert sorted(r[0] for r in tables.sitemap_pages(df, "root").collect()) == ["p1", "p2", "p3"]
    assert sorted(r[0] for r in tables.sitemap_pages(df, "root", 2).collect()) == ["p1", "p2"]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in (("a.md", "# One\nx"), ("b.mdx", "title: 'Two'"), ("empty.md", ""), ("big.md", "x" * 2000), ("n.txt", "plain"), ("x.bin", "no")):
        (tmp_path / "d" / name).write_text(body)
    docs = tables.markdown_docs(spark, str(tmp_path), "docs", 1000).collect()
    assert [(r["key"].split("/")[-1], r["title"]) for r in docs] == [("a.md", "One"), ("b.mdx", "Two")] and docs[0]["key"].startswith("docs:")
    found = {r["path"].split("/")[-1]: (r["mime"], r["text"]) for r in tables.uploads(spark, str(tmp_path)).collect()}
    assert found["n.txt"] == ("text/plain", "plain") and "x.bin" not in found
    names = [(r["name"], r["length"], r["mime"]) for r in tables.imported(spark, str(tmp_path / "d" / "*.md"), 1000).orderBy("name").collect()]
    assert names == [("a.md", 7, "text/markdown")]


def test_markdown_as_text(spark):
    given = "# Head *it*\n\ntext **bold** __b__ snake_case_name ~~gone~~ `a*b*c` and ![pic](i.png) [t](u \"x\")\n\n\n\n> quoted\n***\n```py\n# code *stays*\n[x](y)\n```\nend `open"
    want = "Head it\n\ntext bold b snake_case_name gone a*b*c and pic t\n\nquoted\n\n# code *stays*\n[x](y)\nend `open"
    assert one(spark, given, text.plain_text) == want
    assert one(spark, "```\na **b**\n```", text.plain_text) == "a **b**"
    assert one(spark, "", text.plain_text) == "" and one(spark, None, text.plain_text) is None
    assert one(spark, "* item\n* item", text.plain_text) == "* item\n* item"


def test_words_and_stems(spark):
    assert one(spark, "The Läufer's 日本 naïve_x a1 b", text.tokens) == ["the", "läufer", "s", "日本", "naïve_x", "a1", "b"]
    words = "studies boxes classes dogs running hoped quickly bus glass is sing red".split()
    assert one(spark, " ".join(words), lambda c: text.search_tokens(c, [])) == ["studi", "box", "class", "dog", "run", "hope", "quick", "bus", "glass", "is", "sing", "red"]


def test_claims_in_sentences(spark):
    says = lambda s: one(spark, s, lambda c: text.asserts(c, [r"\bi (?:have )?launched\b"], [r"\bi will launch\b"], r"\bnot\b|n't", r"\bif\b|\bwould you\b"))
    for s, want in [("I launched it.", True), ("Did it. I have launched it", True), ("I launched it?", False), ("I have not launched. I launched", True), ("I did not. I will launch soon!", True), ("If you like I will launch", False), ("I will launch if you like", False), ("I launched it if you look", True), ("", False), (None, False)]:
        assert says(s) is want, s


def test_json_containment_and_nesting(spark):
    doc = '{"a": {"b": [1, "x", {"c": 2, "d": null}]}, "n": 5.0, "s": "5", "t": true, "z": null}'
    holds = lambda w, d=doc: one(spark, d, lambda c: json.contains(c, w))
    for w in ({}, {"n": 5}, {"s": "5"}, {"t": True}, {"z": None}, {"a": {"b": ["x", 1]}}, {"a": {"b": [{"c": 2}]}}, {"a": {"b": []}}):
        assert holds(w) is True, w
    for w in ({"s": 5}, {"n": "5"}, {"t": 1}, {"q": None}, {"a": {"b": [2]}}, {"a": {"b": {"c": 2}}}, {"a": []}, [1], {"a": {"b": [{"c": 2, "d": 1}]}}):
        assert holds(w) is False, w
    assert holds([1, {"k": 2}], '[3, 1, {"k": 2, "l": 0}]') is True and holds(3, "[3]") is True and holds(3, "[[3]]") is False
    assert holds({}, "bad") is False and holds({}, None) is False
    assert one(spark, '{"a":{"b":[1]},"k":1}', lambda c: F.to_json(json.without(c, ["k"]))) == '{"a":{"b":[1]}}'
    assert one(spark, '{"a":{"y":1,"x":2}}', lambda c: json.differs(c, F.lit('{"a":{"x":2,"y":1}}'))) is False
    assert one(spark, '{"a":{"y":1,"x":2}}', lambda c: json.differs(c, F.lit('{"a":{"x":2,"y":3}}'))) is True


def test_requests_and_settings():
    fine = [{"id": "a", "top_k": 5, "similarity_threshold": 0.5, "retrieval_method": "hybrid", "filter_metadata": {}}, {"id": "b"}]
    assert params.request_problem(fine) is None
    for bad in (None, [], [{"id": "a"}] * 2, [{"id": str(i)} for i in range(11)], [{}], [{"id": "a", "x": 1}], [{"id": "a", "top_k": 0}], [{"id": "a", "top_k": True}], [{"id": "a", "similarity_threshold": 2}], [{"id": "a", "retrieval_method": "no"}], [{"id": "a", "filter_metadata": []}]):
        assert params.request_problem(bad), bad
    assert [params.setting(*a) for a in (("7", "int", 1), ("x", "int", 1), (None, "int", 1), ("0.5", "float", 1.0), ("YES", "bool", False), ("no", "bool", True), ("s", "str", ""))] == [7, 1, 1, 0.5, True, False, "s"]
    assert params.setting_problem("x", "int") and params.setting_problem(9, "int", 1, 5) and params.setting_problem("c", "str", choices=["a"]) and params.setting_problem(3, "int", 1, 5) is None
    assert params.run_method({"hybrid": lambda k: ("h", k)}, "chunk_embed", k=3) == ("h", 3)


def test_upserts_take_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, at int")
    new = spark.createDataFrame([(2, "x", 1), (2, "w", 2), (3, "c", 1), (3, "c", 1)], "id long, v string, at int")
    assert rows(state.upserted(old, new, "id", ["at"])) == [(1, "a", 0), (2, "w", 2), (3, "c", 1)]
    assert rows(state.upserted(old, new, "id")) == [(1, "a", 0), (2, "x", 1), (3, "c", 1)]


def test_bases_that_fail_leave_the_others(spark):
    good = lambda: spark.createDataFrame([(1, 0.5), (2, 0.9)], "item long, score double")

    def bad():
        raise LookupError("no index\nat all")

    found, errors = retrieval.fanned_out({"a": good, "b": bad}, "item", 1)
    assert rows(found.select("item", "knowledge_base")) == [(2, "a")] and errors == {"b": "no index"}
    assert retrieval.fanned_out({"b": bad}, "item", 1)[0] is None


def test_pages_of_items(spark):
    cases = [('{"pages": [3, 1, 3]}', [1, 3]), ('{"pages": ["2", "x", null]}', [2]), ('{"pages": ["x"], "start_page": 4, "end_page": 5}', [4, 5]), ('{"start_page": 2}', [2]), ('{"end_page": 2}', []), ('{"start_page": "a", "end_page": 3}', []), ('{"start_page": 5, "end_page": 4}', []), ("{}", []), (None, []), ("bad", [])]
    for given, want in cases:
        assert one(spark, given, structure.item_pages) == want, given


def test_stream_limiter_equals_batch(spark, tmp_path):
    start, rng = dt.datetime(2024, 1, 1), random.Random(5)
    data = [(i, rng.choice("abc"), start + dt.timedelta(seconds=3 * i)) for i in range(200)]
    df = spark.createDataFrame(data, "event_id long, who string, ts timestamp_ntz")
    for k in range(2):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.limited(events.ledger(spark, str(tmp_path / "in"), df.schema), "who", "event_id", 2, 60)
        events.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(state.sliding_window(df, "who", "ts", "event_id", 2, 60))


def test_stream_takes_each_key_once(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 20, day + dt.timedelta(seconds=i)) for i in range(60)], "event_id long, ts timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.once(events.ledger(spark, str(tmp_path / "in"), df.schema), "event_id")
    events.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_list_params():
    p = params.list_params({"limit": "1000", "offset": "-3", "q": "  x ", "order": "ASC"}, ["name", "id"])
    assert (p.limit, p.offset, p.q, p.sort, p.descending) == (100, 0, "x", "name", False)
    p = params.list_params({"limit": "bad", "sort": "id", "q": "y" * 300}, ["name", "id"])
    assert (p.limit, p.offset, len(p.q), p.sort, p.descending) == (50, 0, 200, "id", True)
    for bad in ({"sort": "nope"}, {"order": "up"}):
        with pytest.raises(ValueError):
            params.list_params(bad, ["name", "id"])


def test_stream_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    data = [(i, day + dt.timedelta(minutes=7 * i), "error" if i % 5 == 0 else "view", float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, event_type string, value double")
    for k in range(2):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.buckets(events.ledger(spark, str(tmp_path / "in"), df.schema), "hour", delay="0 seconds")
        events.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got, batch = rows(spark.read.parquet(str(tmp_path / "out"))), rows(events.buckets(df, "hour"))
    assert got and got == batch[: len(got)] and len(batch) - len(got) <= 2
