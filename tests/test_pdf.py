"""PDF files made here, object by object."""

import struct
import zlib

import pytest
from foliant.sources import pdf


def made(objects, trailer="/Root 1 0 R"):
    out = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
    for number, body in objects.items():
        out += b"%d 0 obj\n" % number + (body if isinstance(body, bytes) else body.encode()) + b"\nendobj\n"
    return out + f"trailer\n<< {trailer} >>\n%%EOF".encode()


def stream(data, about="", pack=True):
    data = data if isinstance(data, bytes) else data.encode("latin-1")
    packed = zlib.compress(data) if pack else data
    return f"<< /Length {len(packed)} {'/Filter /FlateDecode' if pack else ''} {about} >>\nstream\n".encode() + packed + b"\nendstream"


CMAP = "1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <4F60> endbfchar 2 beginbfrange <0002> <0003> <0041> <0010> <0011> [<597D> <0021>] endbfrange"


def sample():
    return made({
        1: "<< /Type /Catalog /Pages 2 0 R /Outlines 20 0 R /Names << /Dests << /Names [(two) [4 0 R /Fit]] >> >> >>",
        2: "<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im 8 0 R >> >> >>",
        3: "<< /Type /Page /Parent 2 0 R /Contents [10 0 R 11 0 R] >>",
        9: "<< /Type /Pages /Parent 2 0 R /Kids [4 0 R 12 0 R] >>",
        4: "<< /Type /Page /Contents 13 0 R /Resources << /Font << /F2 6 0 R >> /XObject << /Fm 14 0 R >> >> >>",
        12: "<< /Type /Page /Contents 15 0 R /Resources << /XObject << /J 16 0 R >> >> >>",
        5: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        6: "<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
        7: stream(CMAP),
        8: stream(b"\xff\0\0\0\xff\0" * 2, "/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8"),
        10: stream("BT /F1 12 Tf 72 720 Td (PDF \\(example\\) te\\170t) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET"),
        11: stream("BT /F1 12 Tf 1 0 0 1 72 600 Tm (caf\xe9) Tj 1 0 0 1 300 600 Tm (right) Tj ET", pack=False),
        13: stream("BT /F2 12 Tf 10 10 Td <00010010> Tj ET q /Fm Do Q"),
        14: stream("BT /F2 9 Tf 10 5 Td <000200030011> Tj ET", "/Subtype /Form"),
        15: stream("q 1 0 0 1 0 0 cm /J Do Q BI /W 1 /H 1 ID (((\nEI Q"),
        16: stream(b"\xff\xd8jpeg", "/Subtype /Image /Filter /DCTDecode", pack=False),
        20: "<< /First 21 0 R >>",
        21: "<< /Title (Part one) /Dest [3 0 R /Fit] /Next 23 0 R /First 22 0 R >>",
        22: b"<< /Title <FEFF4F60597D> /A << /S /GoTo /D (two) >> >>",
        23: "<< /Title (  ) /Next 24 0 R >>",
        24: "<< /Title (Last) /Dest [12 0 R /XYZ 0 0 0] >>",
    })


def test_pages_text_and_images():
    got = pdf.pages_of("x", sample())
    assert [r[1] for r in got] == [1, 2, 3]
    assert got[0][2] == "PDF (example) text\nsecond line\ncafé right"
    assert got[1][2] == "你好\nAB!" and got[2][2] == ""
    assert got[0][4] is None and got[2][4] == "scanned_page_no_text: page 3"
    assert [i["name"] for i in got[0][3]] == ["page-001-img-001.png"] and got[2][3][0] == {"name": "page-003-img-001.jpg", "data": b"\xff\xd8jpeg"}
    png = got[0][3][0]["data"]
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (2, 2)
    assert zlib.decompress(png[41 : 41 + struct.unpack(">I", png[33:37])[0]]) == (b"\0" + b"\xff\0\0\0\xff\0") * 2


def test_objects_in_streams_and_faults():
    inner = {30: "<< /Type /Pages /Kids [31 0 R] >>", 31: "<< /Type /Page /Contents 33 0 R /Resources << /Font << /F 34 0 R >> >> >>", 34: "<< /Subtype /Type1 >>"}
    bodies, places = "", []
    for n, x in inner.items():
        places.append(f"{n} {len(bodies)}")
        bodies += x + " "
    head = " ".join(places) + " "
    data = made({1: "<< /Type /Catalog /Pages 30 0 R >>", 32: stream(head + bodies, f"/Type /ObjStm /N 3 /First {len(head)}"), 33: stream("BT /F 1 Tf (inner) Tj ET")})
    assert pdf.pages_of("x", data)[0][2] == "inner"
    assert "no PDF" in pdf.pages_of("x", b"PK\x03\x04")[0][5] and "no PDF" in pdf.pages_of("x", b"")[0][5]
    assert "encrypted" in pdf.pages_of("x", made({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [] >>"}, "/Root 1 0 R /Encrypt 9 0 R"))[0][5]
    assert pdf.pages_of("x", made({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [2 0 R 1 0 R] >>"}))
    whole = sample()
    for at in range(0, len(whole), 37):  # whatever is cut off, there are rows
        assert pdf.pages_of("x", whole[:at])


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample())
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = pdf.pages(files)
    rows = {(r["path"][-5:], r["page"]): r for r in found.collect()}
    assert len(rows) == 4 and rows["b.pdf", None]["error"] and rows["a.pdf", 2]["text"] == "你好\nAB!"
    md = pdf.markdown(found).collect()
    assert len(md) == 1 and md[0]["content_md"].startswith("## Page 1\n\nPDF (example) text\n") and md[0]["content_md"].endswith("## Page 3\n\n![](images/page-003-img-001.jpg)\n")
    marks = pdf.bookmarks(files)
    assert [tuple(r)[1:] for r in marks.select("path", "ord", "level", "title", "page", "parent_ord").orderBy("ord").collect()] == [(0, 1, "Part one", 1, None), (1, 2, "你好", 2, 0), (2, 1, "Last", 3, None)]
    cut = {r["title"]: r["text"] for r in pdf.sections(found, marks).collect()}
    assert cut["Part one"].startswith("PDF") and cut["你好"] == "你好\nAB!" and cut["Last"] == ""
    assert pdf.pages(files.limit(0)).count() == 0 == pdf.bookmarks(files.limit(0)).count()


@pytest.mark.parametrize("text", [b"(a(b)c)", b"(a\\)b)", b"(\\101)", b"<4142>", b"( \\\n)"])
def test_strings(text):
    assert pdf.Scanner(text).value() == {b"(a(b)c)": b"a(b)c", b"(a\\)b)": b"a)b", b"(\\101)": b"A", b"<4142>": b"AB", b"( \\\n)": b" "}[text]
