"""Word documents out: tables as documents of their own, tables put in for placeholders, tables cut out with their styles."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.sources.docx import W

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def table_xml(cells: list[list[dict]]) -> str:
    """A table of cells with text, colspan and rowspan; a cell over several rows goes on in them."""
    width = max((sum(c.get("colspan") or 1 for c in r) for r in cells), default=0)
    going: dict[int, tuple[int, int]] = {}
    out = []
    for row in cells:
        made, column, own, after = [], 0, list(row), {}
        while own or column in going:
            if column in going:
                rows, span = going[column]
                made.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/><w:vMerge/></w:tcPr><w:p/></w:tc>')
            else:
                c = own.pop(0)
                span, rows = c.get("colspan") or 1, c.get("rowspan") or 1
                merge = '<w:vMerge w:val="restart"/>' if rows > 1 else ""
                text = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in (c.get("text") or "").split("\n"))
                made.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{merge}</w:tcPr>{text}</w:tc>')
            if rows > 1:
                after[column] = (rows - 1, span)
            column += span
        going = after
        out.append(f"<w:tr>{''.join(made)}</w:tr>")
    return f'<w:tbl xmlns:w="{NS}"><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid>{"<w:gridCol/>" * width}</w:tblGrid>{"".join(out)}</w:tbl>'


def document(body: str, more: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in PARTS.items():
            z.writestr(zipfile.ZipInfo(name), text)
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>')
        for name, data in (more or {}).items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def plain_cells(rows: list[list[str]]) -> list[list[dict]]:
    return [[{"text": x or ""} for x in r] for r in rows]


def table_bytes(rows: Column) -> Column:
    """A Word document with one table, from array<array<string>>."""

    @F.pandas_udf("binary")
    def made(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else document(table_xml(plain_cells(x))))

    return made(rows)


def _rewritten(data: bytes, root: ET.Element) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            new.writestr(zipfile.ZipInfo(name), ET.tostring(root, encoding="utf-8", xml_declaration=True) if name == "word/document.xml" else old.read(name))
    return out.getvalue()


def embed(data: bytes, tables: dict[str, list[list[str]]]) -> tuple[bytes, list[str]]:
    """The document with each paragraph that refers to a table replaced by it, and the references that were found."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body, found = root.find(f"{W}body"), []
    for k, e in enumerate(list(body)):
        text = "".join(x.text or "" for x in e.iter(f"{W}t")) if e.tag == f"{W}p" else ""
        ref = re.search(t.TABLE_REF_COMMENT, text) or re.search(t.TABLE_REF_MARK, text)
        if ref and ref[1] in tables:
            body[k] = ET.fromstring(table_xml(plain_cells(tables[ref[1]])))
            found.append(ref[1])
    return _rewritten(data, root), found


def patch(data: bytes, index: int, rows: list[list[str]]) -> bytes:
    """The document with the texts of its index-th table's cells replaced, row by row; formats of cells stay."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    table = root.find(f"{W}body").findall(f"{W}tbl")[index]
    for tr, row in zip(table.findall(f"{W}tr"), rows, strict=False):
        for tc, text in zip(tr.findall(f"{W}tc"), row, strict=False):
            runs = list(tc.iter(f"{W}t"))
            if not runs:
                p = tc.find(f"{W}p")
                runs = [ET.SubElement(ET.SubElement(p if p is not None else ET.SubElement(tc, f"{W}p"), f"{W}r"), f"{W}t")]
            runs[0].text = text
            for x in runs[1:]:
                x.text = ""
    return _rewritten(data, root)


def cut(data: bytes, index: int) -> bytes:
    """A document of the index-th table alone, with the styles and numbering that it may refer to."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        table = ET.fromstring(z.read("word/document.xml")).find(f"{W}body").findall(f"{W}tbl")[index]
        more = {n: z.read(n) for n in ("word/styles.xml", "word/numbering.xml") if n in z.namelist()}
    return document(ET.tostring(table, encoding="unicode"), more)
