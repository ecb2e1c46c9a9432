"""Text of files: zipped XML documents, HTML and plain text, a file at a time, in tasks that Spark deals the files to."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

#: Bytes that a part of an archive may unpack to.
LARGEST = 200_000_000
#: Elements of HTML whose text is not shown, and those that begin a line.
UNSEEN = {"script", "style", "template", "noscript", "head", "title"}
LINES = set("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > LARGEST:
        raise ValueError(f"{name} is larger than {LARGEST} bytes")
    body = archive.read(name)
    if b"<!DOCTYPE" in body[:2000] or b"<!ENTITY" in body:
        raise ValueError(f"{name} defines entities")
    return ElementTree.fromstring(body)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _run_text(element: ElementTree.Element) -> str:
    """Text of a paragraph: runs, tabs and line breaks."""
    shown = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _local(x) == "t" else shown.get(_local(x), "") for x in element.iter())


def docx_text(data: bytes) -> str:
    """Paragraphs, a line each, headings marked by #, and the rows of tables with | between the cells."""
    lines: list[str] = []

    def walk(element: ElementTree.Element) -> None:
        for x in element:
            kind = _local(x)
            if kind == "p":
                style = next((v for y in x.iter() if _local(y) == "pStyle" for k, v in y.attrib.items() if k.endswith("val")), "")
                level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
                text = _run_text(x)
                lines.append("#" * int(level[1]) + " " + text if level and text else text)
            elif kind == "tr":
                lines.append(" | ".join(" ".join(t for p in c.iter() if _local(p) == "p" and (t := _run_text(p))) for c in x if _local(c) == "tc"))
            else:
                walk(x)

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        walk(_part(archive, "word/document.xml"))
    return "\n".join(lines).strip("\n")


def xlsx_text(data: bytes) -> str:
    """Sheets in order, their rows a line each with tabs between the cells; empty cells keep their place, empty rows are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        shared = ["".join(t.text or "" for t in x.iter() if _local(t) == "t") for x in _part(archive, "xl/sharedStrings.xml") if _local(x) == "si"] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        if not sheets:
            raise ValueError("no sheets")
        lines = []
        for name in sheets:
            for row in (x for x in _part(archive, name).iter() if _local(x) == "row"):
                cells: list[str] = []
                for c in (x for x in row if _local(x) == "c"):
                    at = _column(c.get("r", ""))
                    cells += [""] * ((len(cells) if at is None else at) - len(cells))
                    held = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                    cells.append(shared[int(held)] if c.get("t") == "s" and held else held)
                if any(cells):
                    lines.append("\t".join(cells))
    return "\n".join(lines)


def _column(reference: str) -> int | None:
    """AB12 to 27."""
    letters = re.match("[A-Z]{1,3}", reference)
    if not letters:
        return None
    n = 0
    for x in letters[0]:
        n = 26 * n + ord(x) - 64
    return n - 1


def pptx_text(data: bytes) -> str:
    """Slides in order, a paragraph a line, a blank line between slides."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        if not slides:
            raise ValueError("no slides")
        told = ("\n".join(t for p in _part(archive, n).iter() if _local(p) == "p" and (t := _run_text(p))) for n in slides)
        return "\n\n".join(told)


class _Shown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.unseen = [], []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen.append(tag)
        if tag == "body":
            self.unseen = []
        if tag in LINES:
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append("\t")

    def handle_endtag(self, tag):
        if tag in self.unseen:
            del self.unseen[self.unseen.index(tag) :]
        if tag in LINES:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(re.sub(r"\s+", " ", data))


def html_text(data: bytes) -> str:
    """What a page shows: a line a block, white space as one blank, blank lines left out."""
    shown = _Shown()
    shown.feed(data.decode("utf-8", "replace"))
    shown.close()
    lines = (re.sub(r"[ ]*\t[ ]*", "\t", line).strip() for line in "".join(shown.parts).split("\n"))
    return "\n".join(re.sub(" +", " ", x) for x in lines if x)


def plain(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


_OFFICE = "application/vnd.openxmlformats-officedocument."
#: MIME type to (kind of derivative, how).
EXTRACTORS = {
    _OFFICE + "wordprocessingml.document": ("markdown", docx_text),
    _OFFICE + "spreadsheetml.sheet": ("text", xlsx_text),
    _OFFICE + "presentationml.presentation": ("text", pptx_text),
    "text/html": ("text", html_text),
    "text/markdown": ("markdown", plain),
}


def extracted(mime: str | None, data: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(kind, text, error) of a file: by its type, any other text type as text, images and binary types without a reader not at all. Broken files have an error."""
    if data is None:
        return None, None, "no content"
    kind, reader = EXTRACTORS.get(mime or "", ("text", plain) if (mime or "").startswith("text/") else (None, None))
    if reader is None:
        return None, None, f"no reader for {mime}"
    try:
        return kind, reader(data), None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, NotImplementedError, RuntimeError, EOFError) as e:
        return None, None, f"{type(e).__name__}: {e}"[:200]
