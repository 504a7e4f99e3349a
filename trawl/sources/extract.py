"""Text out of files: encodings, office documents and markup with the standard library; others by plug-in.

An extractor takes bytes and yields ``(text, heading, page, line_start, line_end)``. What can't be read is an
error row of its file and stops nothing.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Part = tuple[str, str | None, int | None, int | None, int | None]
Extractor = Callable[[bytes], Iterator[Part]]
BLOCK_ROWS = 32


def decode(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8 with or without one, else Windows-1255; what that leaves open is replaced."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1255", "replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element, tag: str = "t") -> str:
    out = []
    for e in node.iter():
        name = _local(e.tag)
        if name == tag and e.text:
            out.append(e.text)
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def docx(data: bytes) -> Iterator[Part]:
    """Paragraphs under their running heading, tables as lines of tab-separated cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    head: str | None = None
    for e in body:
        if _local(e.tag) == "p":
            text = _texts(e).strip()
            style = next((v for x in e.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            if text and style.lower().startswith(("heading", "title")):
                head = text
            if text:
                yield text, head, None, None, None
        elif _local(e.tag) == "tbl":
            rows = ["\t".join(_texts(c).strip() for c in r if _local(c.tag) == "tc") for r in e.iter() if _local(r.tag) == "tr"]
            if any(r.strip() for r in rows):
                yield "\n".join(rows), head, None, None, None


def pptx(data: bytes) -> Iterator[Part]:
    """One part a slide: shapes, then notes; heading ``Slide n``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for i, name in slides:
            texts = []
            notes = f"ppt/notesSlides/notesSlide{i}.xml"
            for part in [name] + [notes] * (notes in names):
                root = ElementTree.fromstring(z.read(part))
                texts += [t for p in root.iter() if _local(p.tag) == "p" if (t := _texts(p).strip())]
            if texts:
                yield "\n".join(texts), f"Slide {i}", i, None, None


def _blocks(rows: list[tuple[int, str]], head: str, numbered: bool) -> Iterator[Part]:
    """Blocks of 32 rows: of row numbers, or of rows that aren't blank."""
    if numbered:
        groups: dict[int, list[tuple[int, str]]] = {}
        for n, r in rows:
            if r.strip():
                groups.setdefault((n - 1) // BLOCK_ROWS, []).append((n, r))
        parts = list(groups.values())
    else:
        kept = [(n, r) for n, r in rows if r.strip()]
        parts = [kept[i : i + BLOCK_ROWS] for i in range(0, len(kept), BLOCK_ROWS)]
    for p in parts:
        yield "\n".join(r for _, r in p), head, None, p[0][0], p[-1][0]


def xlsx(data: bytes) -> Iterator[Part]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = [dict((_local(k), v) for k, v in e.attrib.items()) for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {e.attrib["Id"]: e.attrib["Target"].lstrip("/").removeprefix("xl/") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for i, s in enumerate(sheets, 1):
            part = "xl/" + targets.get(s.get("id", ""), f"worksheets/sheet{i}.xml")
            rows = []
            for at, r in enumerate((e for e in ElementTree.fromstring(z.read(part)).iter() if _local(e.tag) == "row"), 1):
                cells = []
                for c in r:
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind = c.attrib.get("t")
                    if kind == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _texts(c)
                    cells.append(value)
                rows.append((int(r.attrib.get("r", at)), "\t".join(cells)))
            yield from _blocks(rows, s.get("name", f"Sheet {i}"), True)


def ods(data: bytes) -> Iterator[Part]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    for table in (e for e in root.iter() if _local(e.tag) == "table"):
        name = next((v for k, v in table.attrib.items() if _local(k) == "name"), "")
        rows = []
        for n, r in enumerate((e for e in table.iter() if _local(e.tag) == "table-row"), 1):
            rows.append((n, "\t".join("\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p") for c in r if _local(c.tag) == "table-cell")))
        yield from _blocks(rows, name, False)


class _Markup(HTMLParser):
    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol pre blockquote title".split())

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def markup_text(html: str | None) -> str:
    """The text of HTML without tags, scripts and styles, one line for each block."""
    m = _Markup()
    m.feed(html or "")
    m.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(m.out).split("\n"))
    return "\n".join(x for x in lines if x)


_ILLEGAL = re.compile("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, f"<?xml version='1.0' encoding='UTF-8'?>{body}")
    return out.getvalue()


def _xml_lines(text: str) -> list[str]:
    """Lines of a text for XML; characters that it can't hold are left out."""
    from xml.sax.saxutils import escape

    return [escape(_ILLEGAL.sub("", x)) for x in re.split("\r\n|\r|\n", text)]


def write_docx(text: str) -> bytes:
    """A document with a paragraph for each line."""
    body = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{x}</w:t></w:r></w:p>" for x in _xml_lines(text))
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    return _zipped(**{"word/document.xml": f"<w:document xmlns:w='{space}'><w:body>{body}</w:body></w:document>"})


def write_pptx(text: str, lines: int = 12) -> bytes:
    """A slide for so many lines."""
    made, space = _xml_lines(text), "http://schemas.openxmlformats.org/drawingml/2006/main"
    slides = {}
    for i in range(0, len(made), lines):
        body = "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in made[i : i + lines])
        slides[f"ppt/slides/slide{i // lines + 1}.xml"] = f"<p:sld xmlns:p='p' xmlns:a='{space}'>{body}</p:sld>"
    return _zipped(**slides)


def write_xlsx(text: str) -> bytes:
    """A sheet with a row for each line."""
    rows = "".join(f"<row r='{n}'><c t='inlineStr'><is><t xml:space='preserve'>{x}</t></is></c></row>" for n, x in enumerate(_xml_lines(text), 1))
    return _zipped(**{"xl/workbook.xml": "<workbook><sheets><sheet name='Sheet' sheetId='1'/></sheets></workbook>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def write_ods(text: str) -> bytes:
    """A sheet with a row for each line."""
    rows = "".join(f"<t:table-row><t:table-cell><x:p>{x}</x:p></t:table-cell></t:table-row>" for x in _xml_lines(text))
    return _zipped(**{"content.xml": f"<d xmlns:t='t' xmlns:x='x'><t:table t:name='Sheet'>{rows}</t:table></d>"})


WRITERS = {"docx": write_docx, "pptx": write_pptx, "xlsx": write_xlsx, "ods": write_ods}


def written(text, extension: str):
    """A text as a file of a format; null stays null."""
    write_one = WRITERS[extension]

    @F.pandas_udf("binary")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else write_one(t))

    return write(text)


EXTRACTORS: dict[str, Extractor] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "ods": ods}


def register(extension: str, extractor: Extractor) -> None:
    """Add an extractor, for PDF, images or media where their libraries are there."""
    EXTRACTORS[extension.lower()] = extractor


def extract(files: DataFrame, content: str = "content", extension: str = "extension", kind: str = "kind") -> DataFrame:
    """The other columns of ``files`` with ``part`` from 0, ``text``, ``heading``, ``page``, ``line_start``, ``line_end``, ``error``.

    Text and code are decoded whole. A kind without an extractor, and a file that can't be read, is one row
    with ``error``; binary files have no row.
    """
    known = dict(EXTRACTORS)

    @F.pandas_udf("array<struct<text:string,heading:string,page:int,line_start:int,line_end:int,error:string>>")
    def parts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("text", "heading", "page", "line_start", "line_end", "error")
        for data, extensions, kinds in batches:
            out = []
            for d, e, k in zip(data, extensions, kinds):
                if d is None or k == "binary":
                    out.append([])
                    continue
                try:
                    if k in ("text", "code"):
                        rows = [(decode(bytes(d)), None, None, None, None, None)]
                    elif e in known:
                        rows = [(*p, None) for p in known[e](bytes(d))]
                    else:
                        rows = [(None,) * 5 + (f"No extractor for {e}",)]
                except Exception as err:  # one file's fault is its own
                    rows = [(None,) * 5 + (f"{type(err).__name__}: {err}"[:500],)]
                out.append([dict(zip(names, r)) for r in rows])
            yield pd.Series(out)

    parts = parts.asNondeterministic()  # else a filter made of it is pushed down, and it runs twice
    kept = [c for c in files.columns if c != content]
    made = files.select(*kept, parts(F.col(content), F.col(extension), F.col(kind)).alias("__p"))
    return made.select(*kept, F.posexplode("__p").alias("part", "p")).select(*kept, "part", "p.*")
