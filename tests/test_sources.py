"""Word documents made here from their parts, web pages, the call log as a stream, the repository's own shape."""

import io
import json
import pathlib
import re
import subprocess
import sys
import zipfile

from foliant.sources import docx, html, workspace
from foliant.streaming import call_log

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def p(text="", style="", num=None, outline=None, images=()):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "") + (f'<w:outlineLvl w:val="{outline}"/>' if outline is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r>{''.join(f'<w:r><a:blip r:embed="{x}"/></w:r>' for x in images)}</w:p>"


def cell(text, span=1, merge=None):
    props = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + (f'<w:vMerge w:val="{merge}"/>' if merge else "")
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"


def made(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H9"><w:name w:val="Heading 9"/></w:style><w:style w:styleId="T1"><w:name w:val="toc 1"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="chineseCounting"/><w:lvlText w:val="%1、"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="(%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/x.PNG"/><Relationship Id="r2" Target="media/y.jpg"/></Relationships>')
    return out.getvalue()


def test_docx_blocks():
    data = made(p("Title", "H1"), p("body"), p("first", num=(1, 0)), p("sub", num=(1, 1)), p("second", num=(1, 0)), p("sub again", num=(1, 1)), p("1.2 Scope", outline=1), p("deep", "H9"), p("Contents ... 12", "T1"), p(images=["r2", "r2", "r1"]), p("x", images=["r2"]), f"<w:tbl><w:tr>{cell('a', 2)}{cell('m', merge='restart')}</w:tr><w:tr>{cell('b')}{cell('c')}{cell('', merge='continue')}</w:tr></w:tbl>")
    b = docx.parse(data)
    assert [(x["block_type"], x["level"], x["text"]) for x in b[:9]] == [("heading", 1, "Title"), ("paragraph", None, "body"), ("paragraph", None, "一、first"), ("paragraph", None, "(1)sub"), ("paragraph", None, "二、second"), ("paragraph", None, "(1)sub again"), ("heading", 2, "1.2 Scope"), ("heading", 8, "deep"), ("toc", 1, "Contents")]
    assert [x["image_ref"] for x in b if x["block_type"] == "image"] == ["images/docx-img-001.jpg", "images/docx-img-002.png", "images/docx-img-001.jpg"]
    t = b[-1]
    assert t["rows"] == [["a", "m"], ["b", "c"]] and t["cells"][0][0]["colspan"] == 2 and t["cells"][0][1]["rowspan"] == 2


def test_docx_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(made(p("Title", "H1"), p("body")))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.pdf").write_bytes(b"%PDX")
    (tmp_path / "e.doc").write_bytes(b"old")
    (tmp_path / "d.docx").write_bytes(made())
    got = docx.read(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert [r["text"] for r in by["a.docx"]] == ["Title", "body"] and "d.docx" not in by
    assert "BadZipFile" in by["b.docx"][0]["error"] and "no PDF file" in by["c.pdf"][0]["error"] and "unsupported type: doc" in by["e.doc"][0]["error"]


def test_html(spark):
    df = spark.createDataFrame([(1, "<html><head><title>x</title></head><body><nav>m</nav><h2>A &amp; B</h2><p>one<b>two</b></p><ul><li>i</ul></body>"), (2, None)], "page_id int, html string")
    assert [(r["block_type"], r["level"], r["text"]) for r in html.blocks(df).orderBy("block_index").collect()] == [("heading", 2, "A & B"), ("paragraph", 0, "onetwo"), ("list_item", 0, "i")]


def test_workspace_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "extract", "done", "content.md", ["w"]), (1, "chunk", "failed", None, [])], "doc_id int, stage string, status string, output string, warnings array<string>")
    workspace.write(df, str(tmp_path), "stages")
    m = json.loads(workspace.manifest(workspace.read(spark, str(tmp_path), "stages")).first()["manifest"])
    assert m["status"] == "partial_success" and m["stages"]["extract"]["warnings"] == ["w"]
    b = spark.createDataFrame([(1, 0, "paragraph", "t", None), (1, 1, "image", None, "i.png")], "doc_id int, block_index int, block_type string, text string, ref string")
    a = spark.createDataFrame([(1, "i.png", "a1")], "doc_id int, ref string, asset_id string")
    assert json.loads(workspace.blocks_json(b, a).first()["json"])["blocks"] == [{"block_index": 0, "type": "paragraph", "text": "t"}, {"block_index": 1, "type": "image", "ref": "i.png", "asset_id": "a1"}]


def test_call_log_stream(spark, tmp_path):
    events = [("2024-01-01T00:00:00Z", "a", 1, "prompt", "p1"), ("2024-01-01T00:01:00Z", "a", 2, "response", "r1"), ("2024-01-01T00:02:00Z", "a", 3, "prompt", "p2"), ("2024-01-01T00:03:00Z", "a", 4, "attempt", ""), ("2024-01-01T00:03:30Z", "b", 1, "attempt", "")]
    for k, e in enumerate(events):
        (tmp_path / f"{k}.json").write_text(json.dumps(dict(zip(["ts", "call_key", "ord", "event", "body"], e, strict=True))))
    stream = call_log.calls(call_log.read(spark, str(tmp_path), 2))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("calls").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("calls").collect()] == [("a", 3, "p2", None, 1)]
    q = call_log.rates(call_log.read(spark, str(tmp_path))).writeStream.outputMode("append").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()


ROOT = pathlib.Path(__file__).parent.parent


def test_library_stands_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "foliant", tmp_path / "foliant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert re.match(r"\d\d True", done.stdout), done.stderr


def test_nothing_else_imports_llm():
    for f in (ROOT / "foliant").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "foliant").parts:
            assert not re.search(r"foliant\.llm|from \.+llm", f.read_text()), f


def test_image_bytes_and_pdf_blocks(spark):
    from test_pdf import sample

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/image" Target="media/x.PNG"/><Relationship Id="r2" Type="http://x/image" Target="http://far" TargetMode="External"/><Relationship Id="r3" Type="http://x/styles" Target="styles.xml"/></Relationships>')
        z.writestr("word/media/x.PNG", b"\x89PNG")
    df = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"broken")), ("c.pdf", bytearray(sample()))], "path string, content binary")
    assert [tuple(r)[:3] + (bytes(r["data"]),) for r in docx.media(df).collect()] == [("a.docx", "r1", "media/x.PNG", b"\x89PNG")]
    found = sorted((r["block_index"], r["block_type"], r["text"], r["image_ref"]) for r in docx.from_bytes(df).where("path = 'c.pdf'").collect())
    assert found[0] == (0, "heading", "Page 1", None) and found[2] == (2, "image", None, "images/page-001-img-001.png") and len(found) == 7


def test_body_text_level_is_no_heading():
    b = docx.parse(made(p("1.2 Scope", outline=9), p("1.3 Scope", outline=1)))
    assert [x["block_type"] for x in b] == ["paragraph", "heading"]
