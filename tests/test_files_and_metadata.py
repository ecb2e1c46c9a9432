"""Extraction from files, metadata tables whose fields change, markdown sections."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from fathom.functions import office
from fathom.operators import state, structure
from fathom.operators.metadata import MetadataTable
from fathom.plans import queries
from fathom.sources import tables
from fathom.streaming import events


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed(
    word__document=f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">One </w:t></w:r><w:r><w:t>two</w:t><w:tab/><w:t>é&amp;</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
)
XLSX = packed(
    xl__sharedStrings="<sst><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>",
    xl__worksheets__sheet2="<worksheet><sheetData><row><c r='A1' t='inlineStr'><is><t>second</t></is></c></row></sheetData></worksheet>",
    xl__worksheets__sheet1="<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row/><row><c r='B3'><v>4.5</v></c></row></sheetData></worksheet>",
)
PPTX = packed(ppt__slides__slide10="<s><p><r><t>ten</t></r></p></s>", ppt__slides__slide2="<s><p><r><t>two</t></r></p><p/></s>")
HTML = "<html><head><title>no</title><style>x{}</style></head><body><h1>A &amp;  b</h1><p>c<br>d <b>e</b></p><script>1</script><table><tr><td>1</td><td>2</td></tr></table></body></html>".encode()
FILES = {
    "a.docx": (DOCX, "markdown", "## Title\nOne two\té&\na | b"),
    "b.xlsx": (XLSX, "text", "name\t\tvalue\n\t4.5\nsecond"),
    "c.pptx": (PPTX, "text", "two\n\nten"),
    "d.HTML": (HTML, "text", "A & b\nc\nd e\n1\t2"),
    "e.md": ("# é".encode(), "markdown", "# é"),
    "f.txt": (b"\xef\xbb\xbfplain \xff", "text", "plain �"),
    "g.docx": (b"no archive", None, None),
    "h.docx": (DOCX[:200], None, None),
    "i.xlsx": (DOCX, None, None),
    "j.docx": (packed(word__document="<w:p"), None, None),
    "k.docx": (packed(word__document="<!DOCTYPE x [<!ENTITY e 'x'>]><d>&e;</d>"), None, None),
    "l.png": (b"\x89PNG", None, None),
    "m.pdf": (b"%PDF", None, None),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "deep").mkdir()
    for k, (name, (body, _, _)) in enumerate(FILES.items()):
        (top / ("deep" if k % 2 else ".") / name).write_bytes(body)
    (top / "x.exe").write_bytes(b"MZ")
    (top / "empty.txt").write_bytes(b"")  # Spark lists no files without bytes
    return str(top)


def seen(df):
    return {r.path.rsplit("/", 1)[-1]: (r.kind, r.text, r.error is None) for r in df.collect()}


def test_files_of_a_batch_and_a_stream(spark, folder, tmp_path):
    got = seen(tables.extracted_files(tables.files(spark, folder)))
    assert got == {n: (kind, text, kind is not None) for n, (_, kind, text) in FILES.items()}
    ticks = events.Ticks(spark, str(tmp_path / "out"))
    ticks.start(tables.extracted_files(tables.arrivals(spark, folder, 5))).awaitTermination(180)
    assert seen(ticks.rows()) == got and ticks.rows().count() == len(FILES) and ticks.log.version() == 3


def test_pages_as_files(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.path: (r.kind, r.text, r.error) for r in queries.queries()["page_files"](spark, folder).collect()}
    assert got == {f"{r.page_id}.html": ("text", office.html_text(r.html.encode()), None) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}


def test_a_part_that_unpacks_to_too_much_is_refused(monkeypatch):
    monkeypatch.setattr(office, "LARGEST", 10)
    assert office.extracted(tables.MIME_TYPES["docx"], DOCX)[2].startswith("ValueError: word/document.xml is larger")
    assert office.extracted(None, b"x") == (None, None, "no reader for None") and office.extracted("text/plain", None)[2] == "no content"


def field(name, kind, **more):
    return {"name": name, "type": kind, "description": name} | more


def answers(spark, rows):
    return spark.createDataFrame([(i, "chunk", a, e) for i, a, e in rows], "item_id string, item_type string, answer string, error string")


def told(table, *columns, version=None):
    return {r["item_id"]: tuple(r[c] for c in columns) for r in table.rows(version).collect()}


def test_fields_come_and_go(spark, tmp_path):
    table = MetadataTable(spark, str(tmp_path))
    with pytest.raises(LookupError):
        table.rows()
    with pytest.raises(ValueError):
        table.define([field("a", "wrong")])
    table.define([field("n", "number"), field("kind", "enum", enum_values=["Red", "blue"]), field("old", "text")])
    first = table.enrich(answers(spark, [("1", '{"n": "4.5", "kind": "RED", "old": "x"}', None), ("2", '{"n": "many", "kind": "green"}', None), ("3", "[1]", None), ("4", None, "timeout")]))
    assert told(table, "n", "kind", "old", "_enrichment_error") == {"1": (4.5, "Red", "x", None), "2": (None, None, None, None), "3": (None, None, None, "no object"), "4": (None, None, None, "timeout")}
    items = spark.createDataFrame([(k,) for k in range(1, 7)], "id int")
    sets = lambda choice: sorted(r["id"] for r in table.to_enrich(items, "id", choice).collect())
    assert (sets("all"), sets("unenriched"), sets("failed")) == ([1, 2, 3, 4, 5, 6], [5, 6], [3, 4])
    table.define([field("N", "boolean"), field("kind", "enum", enum_values=["blue", "red"]), field("new", "boolean")])
    table.enrich(answers(spark, [("2", '{"N": 1, "kind": "blue", "new": "no"}', None), ("5", '{"new": true}', None)]))
    assert table.rows().columns == ["item_id", "item_type", "enriched_at", "_enrichment_error", "N", "kind", "new"]
    now = {"1": (None, "red", None), "2": (True, "blue", False), "3": (None, None, None), "4": (None, None, None), "5": (None, None, True)}
    assert told(table, "N", "kind", "new") == now
    assert told(table, "n", "old", version=first)["1"] == (4.5, "x"), "a version stays what it was"
    table.remove(spark.createDataFrame([("1",), ("2",), ("77",)], "item_id string"))
    assert set(told(table, "N")) == {"3", "4", "5"}
    table.enrich(answers(spark, [("2", '{"N": false}', None)]))
    assert told(table, "N")["2"] == (False,)
    table.enrich(answers(spark, [("9", "{}", None)]), full=True)
    assert told(table, "N", "_enrichment_error") == {"9": (None, None)}


def test_work_sets_of_repeated_results(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    results = spark.createDataFrame([(1, None), (2, None), (2, "bad"), (9, "bad")], "id int, error string")
    assert sorted(map(tuple, state.work_sets(items, results, "id").collect())) == [(1, "all"), (2, "all"), (2, "failed"), (3, "all"), (3, "unenriched")]


def test_headings_in_code_are_no_headings(spark):
    text = "intro\n# One\n```py\n# comment\n## more\n```\ntail\n## Two\n~~~\n```\n# open fence"
    got = structure.header_chunks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("section").collect()
    assert [(r.heading, r.text) for r in got] == [(None, "intro\n"), ("One", "# One\n```py\n# comment\n## more\n```\ntail\n"), ("Two", "## Two\n~~~\n```\n# open fence")]


def test_links_without_quotes(spark):
    html = "<a href=u.html>1</a><A class=k href = /v?x=1#top>2</A><a href='#x'>3</a><a href=>4</a><a data-x=1 href=\"w\">5</a>"
    page = spark.createDataFrame([(1, "http://x.org/a/c.html", html), (2, None, None)], "page_id long, url string, html string")
    got = [(r.page_id, r.position, r.link) for r in tables.links(page).collect()]
    assert got == [(1, 0, "http://x.org/a/u.html"), (1, 1, "http://x.org/v?x=1"), (1, 2, "http://x.org/a/w")]


def test_files_reach_the_extractor_in_small_batches(spark):
    """Whole files are held several times over: not the default of 10,000 at once; a number of the session's own stays."""
    from fathom.sources import tables

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.createDataFrame([("a.html", None, 3, b"<p>x")], tables.FILES)
    try:
        for given, want in (("10000", 500), ("700", 700)):
            spark.conf.set(name, given)
            assert [r.error for r in tables.extracted_files(rows).collect()] == [None]
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
