"""Word documents as block rows: one task per file, standard library only.

Files come through Spark's binaryFile source, so any store that Spark reads will do. A file that can't be
parsed, or whose type isn't supported, is a row with an error; the job goes on.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as t

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELL = "struct<text:string,colspan:int,rowspan:int>"
SCHEMA = f"path string, block_index int, block_type string, level int, text string, image_ref string, table_ref string, cells array<array<{CELL}>>, rows array<array<string>>, error string"
STYLE_LEVEL = re.compile(r"^(?:heading|标题)\s*(\d+)$", re.I)
TOC_LEVEL = re.compile(r"^toc\s*(\d+)$", re.I)


def number_text(value: int, form: str) -> str:
    """A list number in its form; the same as functions.text.format_number()."""
    if form in ("chineseCounting", "chineseCountingThousand", "ideographTraditional") and 0 < value < 1000:
        ones, tens, hundreds = value % 10, value // 10 % 10, value // 100
        digit = t.COUNTING
        if not hundreds:
            return ("" if tens < 2 else digit[tens]) + "十" * (tens > 0) + (digit[ones] if ones else "")
        rest = "" if value % 100 == 0 else "零" + digit[ones] if not tens else number_text(value % 100, form)
        return digit[hundreds] + "百" + rest
    if form in ("chineseLegalSimplified", "chineseLegalTenThousand") and 0 < value < 10:
        return t.LEGAL[value]
    return str(value)


@dataclass
class Numbering:
    """Counters of the document's lists: a paragraph counts up its level and starts the deeper ones anew."""

    levels: dict[str, dict[int, tuple[str, str, int]]] = field(default_factory=dict)
    counts: dict[str, dict[int, int]] = field(default_factory=dict)

    @classmethod
    def read(cls, xml: bytes | None) -> Numbering:
        made = cls()
        if xml is None:
            return made
        root = ET.fromstring(xml)
        value = lambda e, tag, default: (x.get(f"{W}val", default) if (x := e.find(f"{W}{tag}")) is not None else default)
        abstract = {a.get(f"{W}abstractNumId"): {int(x.get(f"{W}ilvl", 0)): (value(x, "numFmt", "decimal"), value(x, "lvlText", ""), int(value(x, "start", "1"))) for x in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
        for num in root.findall(f"{W}num"):
            made.levels[num.get(f"{W}numId")] = abstract.get(value(num, "abstractNumId", ""), {})
        return made

    def prefix(self, num_id: str, level: int) -> str | None:
        styles = self.levels.get(num_id)
        if not styles or level not in styles:
            return None
        own = self.counts.setdefault(num_id, {})
        own[level] = own.get(level, styles[level][2] - 1) + 1
        for deeper in [k for k in own if k > level]:
            del own[deeper]
        text = styles[level][1]
        for k in range(level, -1, -1):
            if k in styles:
                text = text.replace(f"%{k + 1}", number_text(own.get(k, styles[k][2]), styles[k][0]))
        return text


def _text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _rids(e: ET.Element) -> list[str]:
    """Embedded images, each once."""
    return list(dict.fromkeys(x.get(f"{REL}embed") for x in e.iter(f"{DRAW}blip") if x.get(f"{REL}embed")))


def grid(table: ET.Element) -> list[list[dict]]:
    """The table's cells with their spans; a cell that goes on from the row above lengthens that one's rowspan."""
    out, open_at = [], {}
    for tr in table.findall(f"{W}tr"):
        row, column = [], 0
        for tc in tr.findall(f"{W}tc"):
            span = tc.find(f"{W}tcPr/{W}gridSpan")
            width = int(span.get(f"{W}val", 1)) if span is not None else 1
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(f"{W}val") != "restart" and column in open_at:
                open_at[column]["rowspan"] += 1
            else:
                cell = {"text": "\n".join(x for p in tc.findall(f"{W}p") if (x := _text(p).strip())), "colspan": width, "rowspan": 1}
                row.append(cell)
                open_at.pop(column, None)
                if merge is not None:
                    open_at[column] = cell
            column += width
        out.append(row)
    return out


def parse(data: bytes, promote: bool = True) -> list[dict]:
    """The document's blocks in order: headings, paragraphs, images, tables, entries of a table of contents."""
    z = zipfile.ZipFile(io.BytesIO(data))
    get = lambda name: z.read(name) if name in z.namelist() else None
    numbering = Numbering.read(get("word/numbering.xml"))
    styles = {}
    if (xml := get("word/styles.xml")) is not None:
        styles = {s.get(f"{W}styleId"): (n.get(f"{W}val", "") if (n := s.find(f"{W}name")) is not None else "") for s in ET.fromstring(xml).findall(f"{W}style")}
    links = {}
    if (xml := get("word/_rels/document.xml.rels")) is not None:
        links = {x.get("Id"): x.get("Target", "") for x in ET.fromstring(xml).findall(f"{LINKS}Relationship")}
    files: dict[str, str] = {}
    out: list[dict] = []

    def add(kind: str, **more) -> None:
        out.append({"block_index": len(out), "block_type": kind, "level": None, "text": None, "image_ref": None, "table_ref": None, "cells": None, "rows": None, "error": None} | more)

    def images(e: ET.Element) -> None:
        for rid in _rids(e):
            if rid in links:
                name = files.setdefault(rid, f"images/docx-img-{len(files) + 1:03d}{(re.search(r'[.][^./]+$', links[rid]) or [''])[0].lower()}")
                add("image", image_ref=name)

    for e in ET.fromstring(z.read("word/document.xml")).find(f"{W}body"):
        if e.tag == f"{W}p":
            props = e.find(f"{W}pPr")
            val = lambda path: (x.get(f"{W}val") if props is not None and (x := props.find(path)) is not None else None)  # noqa: E731, B023
            style = styles.get(val(f"{W}pStyle") or "", val(f"{W}pStyle") or "")
            text = _text(e).strip()
            num_id = val(f"{W}numPr/{W}numId")
            prefix = numbering.prefix(num_id, int(val(f"{W}numPr/{W}ilvl") or 0)) if num_id and num_id != "0" else None
            if text:
                level = int(m[1]) if (m := STYLE_LEVEL.match(style)) else None
                toc = TOC_LEVEL.match(style)
                outlined = val(f"{W}outlineLvl")  # 9 is body text
                by_line = heading_of(text) if promote and outlined is not None and int(outlined) < 9 else None
                if level is None and by_line:
                    level = int(outlined) + 1
                if prefix and not re.match(t.LIST_PREFIX.removeprefix("(?U)"), text) and not heading_of(text) and not text.startswith(prefix):
                    text = prefix + text
                if toc:
                    add("toc", level=min(max(int(toc[1]), 1), 8), text=re.sub(r"[\s.…]*\d+$", "", text))
                elif level is not None:
                    add("heading", level=min(max(level, 1), 8), text=text)
                else:
                    add("paragraph", text=text)
            images(e)
        elif e.tag == f"{W}tbl":
            cells = grid(e)
            rows = [[c["text"] for c in r] for r in cells]
            if any(rows):
                add("table", table_ref=f"tables/t{len(out):04d}.json", cells=cells, rows=rows)
            images(e)
    return out


def heading_of(line: str) -> bool:
    """Whether a line is a numbered heading; what functions.text.heading_line() says of rows, for one line."""
    s = line.strip()
    plain = lambda p: re.match(p.removeprefix("(?U)"), s)
    if not s or len(s) > t.LINE_MOST or plain(t.LIST_ITEM) or plain(t.COLON_BODY) and not plain(t.ENUM):
        return False
    if plain(t.CHAPTER):
        return True
    if m := plain(t.ENUM):
        return bool(m[1].strip()) and not m[1].strip().endswith(("：", ":")) and len(s) <= t.ENUM_MOST
    m = plain(t.SECTIONED) or plain(t.DOTTED) or plain(t.SPACED)
    if not m or not (title := m[2].strip()) or title.endswith(("：", ":")):
        return False
    return "." in m[1] or not (len(title) > t.TITLE_MOST or "：" in title or ":" in title)


def read(spark: SparkSession, path: str, promote: bool = True) -> DataFrame:
    """Block rows of the files under ``path``."""
    return from_bytes(spark.read.format("binaryFile").load(path).select("path", "content"), promote)


def pdf_blocks(path: str, content: bytes) -> list[dict]:
    """A PDF file's blocks: a heading, the text and the images of each page."""
    from foliant.sources import pdf

    out = []
    for _, page, text, found, _, error in pdf.pages_of(path, content):
        if page is None:
            raise ValueError(error)
        out.append({"block_type": "heading", "level": 2, "text": f"Page {page}"})
        if text:
            out.append({"block_type": "paragraph", "text": text})
        out += [{"block_type": "image", "image_ref": f"images/{x['name']}"} for x in found]
    return [x | {"block_index": k} for k, x in enumerate(out)]


def media(df: DataFrame) -> DataFrame:
    """(path, rid, target, data): the bytes of the images that Word files (path, content) refer to, by the id that their text uses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        links = ET.fromstring(z.read("word/_rels/document.xml.rels"))
                        for link in links.iter(f"{LINKS}Relationship"):
                            target = link.get("Target", "")
                            name = target.removeprefix("/") if target.startswith("/") else f"word/{target}"
                            if link.get("Type", "/image").endswith("/image") and link.get("TargetMode") != "External" and name in z.namelist():
                                rows.append((path, link.get("Id"), target, z.read(name)))
                except Exception:  # such a file has its error among the block rows
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "rid", "target", "data"])

    return df.select("path", "content").mapInPandas(run, "path string, rid string, target string, data binary")


def from_bytes(df: DataFrame, promote: bool = True) -> DataFrame:
    """Block rows of files (path, content): Word documents, and PDF files page by page."""
    names = [x.split(" ")[0] for x in re.split(r", (?=\w+ (?:string|int|array))", SCHEMA)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, kind, content in zip(files["path"], files["kind"], files["content"], strict=True):
                try:
                    if kind not in ("docx", "pdf"):
                        raise ValueError(f"unsupported type: {kind}")
                    found = parse(bytes(content), promote) if kind == "docx" else pdf_blocks(path, bytes(content))
                except Exception as e:  # one file's failure is its row's
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([{n: None for n in names} | {"path": path} | b for b in found], columns=names).astype({"block_index": "Int32", "level": "Int32"}) if found else pd.DataFrame(columns=names)

    return df.select("path", t.file_type(F.col("path")).alias("kind"), "content").mapInPandas(run, SCHEMA)
