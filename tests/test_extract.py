import io
import zipfile

from trawl.sources.extract import decode, docx, extract, markup_text, ods, pptx, register, xlsx

W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
A = "xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels"), body)
    return out.getvalue()


def make_docx():
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={s!r}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    return zipped(word__document_xml=f"<w:document {W}><w:body>{p('Head', 'Heading1')}{p('Body')}{p(' ')}{table}</w:body></w:document>")


def make_xlsx():
    row = lambda n, *v: f"<row r='{n}'>" + "".join(f"<c t='inlineStr'><is><t>{x}</t></is></c>" for x in v) + "</row>"
    sheet = "<worksheet><sheetData>" + row(1, "h", "i") + row(2, "", "") + row(40, "x", "y") + "</sheetData></worksheet>"
    return zipped(xl__workbook_xml="<workbook><sheets><sheet name='S' sheetId='1'/></sheets></workbook>", xl__worksheets__sheet1_xml=sheet)


def test_encodings():
    assert decode("שלום".encode("cp1255")) == "שלום"
    assert decode("\ufeffäö".encode()) == "äö" and decode("äö".encode("utf-16")) == "äö" and decode(b"") == ""


def test_office():
    assert list(docx(make_docx())) == [("Head", "Head", None, None, None), ("Body", "Head", None, None, None), ("a\tb", "Head", None, None, None)]
    assert list(xlsx(make_xlsx())) == [("h\ti", "S", None, 1, 1), ("x\ty", "S", None, 40, 40)]
    slide = f"<p:sld xmlns:p='p' {A}><a:p><a:r><a:t>one</a:t></a:r></a:p></p:sld>"
    assert list(pptx(zipped(ppt__slides__slide1_xml=slide, ppt__slides__slide2_xml="<x/>"))) == [("one", "Slide 1", 1, None, None)]
    rows = "".join(f"<t:table-row><t:table-cell><x:p>{i}</x:p></t:table-cell></t:table-row>" for i in range(33))
    made = list(ods(zipped(content_xml=f"<d xmlns:t='t' xmlns:x='x'><t:table t:name='T'>{rows}</t:table></d>")))
    assert [(p[1], p[3], p[4]) for p in made] == [("T", 1, 32), ("T", 33, 33)]


def test_markup():
    assert markup_text("<h1>A</h1><script>x</script><p>b <i>c</i></p>") == "A\nb c" and markup_text(None) == ""


def test_extract_rows(spark):
    register("odd", lambda data: iter([("plug-in", None, 3, None, None)]))
    rows = [
        (1, "txt", "text", b"hi"), (2, "docx", "document", bytearray(make_docx())), (3, "docx", "document", b"broken"), (4, "pdf", "pdf", b"%PDF"),
        (5, "bin", "binary", b"\0"), (6, "txt", "text", None), (7, "odd", "document", b""),
    ]
    df = spark.createDataFrame([(a, b, c, None if d is None else bytearray(d)) for a, b, c, d in rows], "id long, extension string, kind string, content binary")
    got = [(r["id"], r["part"], r["text"], r["page"], r["error"]) for r in extract(df).orderBy("id", "part").collect()]
    assert [g[:3] for g in got] == [(1, 0, "hi"), (2, 0, "Head"), (2, 1, "Body"), (2, 2, "a\tb"), (3, 0, None), (4, 0, None), (7, 0, "plug-in")]
    assert "BadZipFile" in got[4][4] and got[5][4] == "No extractor for pdf" and got[6][3] == 3
