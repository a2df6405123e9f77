"""Jobs with a scripted model, Word documents out, the HTTP client against a server of our own."""

import http.server
import json
import sys
import threading

import pytest
from foliant.operators import http_client, model_calls, outline, ranges, workspace
from foliant.plans import insights, refine
from foliant.sources import docx, docx_write
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

MD = "# Rules\nbidders need a licence\n## Price\nprice counts 30 points\n# Contract\npay late and lose\n"


def answer(messages):
    text = messages[-1]["content"]
    if text.startswith("OVERVIEW"):
        return json.dumps({"overview": "ok", "n": len(json.loads(text.split("\n", 1)[1]))})
    if text.startswith("CHAPTER"):
        return json.dumps({"children": [f"{text[8:]} a", f"{text[8:]} b"]})
    if "Section: " in text:
        return json.dumps({"items": [{"description": "pay late", "confidence": "high"}, {"description": "PAY LATE", "confidence": "low"}]})
    if text.startswith("Segment shard") or "shard-" in text[:20]:
        return json.dumps({"templates": [{"title": "Form", "type": "letter", "markdown": "# Form\nx", "confidence": "high"}]})
    out = {}
    if "licence" in text:
        out["qualifications"] = [{"title": "Licence", "source_excerpt": "need a licence", "confidence": "high"}, {"title": " licence ", "source_excerpt": "", "confidence": "0.2"}]
    if "30 points" in text:
        out["scoring"] = [{"title": "Price", "max_score": 30, "source_excerpt": "price counts", "confidence": "low", "weight": "0.3"}]
    if "late" in text:
        out["risks"] = [{"title": "Late", "severity": " HIGH ", "source_excerpt": "pay late and win", "confidence": None}]
        out["directory"] = [{"title": "d", "inferred": True, "sections": ["A", "B", "a"], "confidence": "high"}]
    return json.dumps(out)


def client():
    class Client:
        def complete(self, messages):
            return answer(messages)

    return Client()


def docs(spark):
    return spark.createDataFrame([(1, MD)], "doc_id int, content_md string")


def nodes(spark):
    n = outline.with_parent(outline.headings(docs(spark), "doc_id", "content_md")).withColumn("size", F.lit(len(MD)).cast("long"))
    n = ranges.same_level_end(ranges.subtree_end(n, "size"), "size")
    return n.withColumn("own_end", F.coalesce(F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("ord")), F.col("size")))


def test_segments(spark):
    got = insights.segments(docs(spark), least=5, most=100).orderBy("ordinal").collect()
    assert "".join(r["text"] for r in got).replace("\n", "") == MD.replace("\n", "") and [r["segment_id"] for r in got][0] == "seg-000"
    assert all(r["char_start"] is not None for r in got)


def test_interpret_and_overview(spark):
    got = insights.interpret(docs(spark), client)
    q = got["qualifications"].collect()
    assert [(r["title"], r["confidence"], MD[r["char_start"] : r["char_end"]]) for r in q] == [("Licence", 0.9, "need a licence")]
    assert [(r["title"], r["weight"], r["confidence"]) for r in got["scoring"].collect()] == [("Price", "0.3", 0.5)]
    r = got["risks"].first()
    assert r["severity"] == "high" and r["confidence"] == 0.8 and MD[r["char_start"] : r["char_end"]].startswith("pay late and ")
    d = got["directory"].first()
    assert d["inferred"] and d["sections"] == ["A", "B"] and d["confidence"] == 0.65
    assert json.loads(insights.overview(got, client).first()["answer"])["n"] == 4


def test_legal_templates_and_outline(spark):
    legal = insights.legal(docs(spark), nodes(spark), client, ["Contract"]).collect()
    assert [(r["description"], r["confidence"], r["char_start"]) for r in legal] == [("pay late", 0.9, MD.index("pay late"))]
    found = insights.templates(docs(spark), nodes(spark), client, size=40, overlap=5).collect()
    assert [(r["template_id"], r["type_id"]) for r in found] == [("tpl-001", "letter-001")]
    start = spark.createDataFrame([(1, 0, "c1", None, "One", False), (1, 1, "c2", None, "Two", False)], "doc_id int, ord int, node_id string, parent_id string, title string, done boolean")
    tree = insights.bid_outline(start, client).collect()
    assert sorted(r["title"] for r in tree) == ["One", "One a", "One b", "Two", "Two a", "Two b"] and all(r["done"] for r in tree)


def test_brief(spark):
    got = insights.brief(docs(spark), lambda: model_calls.ScriptedClient({"SINGLE": '{"summary": "short。long tail of words"}'}), summary=10).first()
    assert got["summary"] == "short。long"


def test_pipeline_links_everything(spark):
    got = insights.pipeline(docs(spark), max_tokens=1000)
    chunks = got["chunks"].collect()
    assert "".join(c["text"] for c in sorted(chunks, key=lambda c: c["ordinal"])) == MD
    links = got["linkage"].collect()
    assert len(links) == 3 and all(r["tree_ids"] and r["chunk_ids"] and not r["missing_tree_node"] for r in links)
    assert got["tree"].where("node_type = 'heading'").count() == 3


def test_word_out_and_in():
    cells = [[{"text": "a", "colspan": 2}, {"text": "m", "rowspan": 2}], [{"text": "b"}, {"text": "c & <d>\ne"}], [{"text": "x"}, {"text": "y"}, {"text": "z"}]]
    back = docx.parse(docx_write.document(docx_write.table_xml(cells)))[0]
    assert [[c["text"] for c in r] for r in back["cells"]] == [["a", "m"], ["b", "c & <d>\ne"], ["x", "y", "z"]]
    assert back["cells"][0][0]["colspan"] == 2 and back["cells"][0][1]["rowspan"] == 2
    para = '<w:p><w:r><w:t>⟦table:t1⟧</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p>'
    data, found = docx_write.embed(docx_write.document(para), {"t1": [["p", "q"]], "t2": [["no"]]})
    assert found == ["t1"] and [b["block_type"] for b in docx.parse(data)] == ["table", "paragraph"]
    assert docx.parse(docx_write.patch(data, 0, [["P"]]))[0]["rows"] == [["P", "q"]]
    assert docx.parse(docx_write.cut(data, 0))[0]["rows"] == [["p", "q"]]


def test_word_column(spark):
    df = spark.createDataFrame([(1, [["a", "b"]]), (2, None)], "id int, rows array<array<string>>")
    got = {r["id"]: r["d"] for r in df.select("id", docx_write.table_bytes(F.col("rows")).alias("d")).collect()}
    assert docx.parse(bytes(got[1]))[0]["rows"] == [["a", "b"]] and got[2] is None


def test_http_client():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            self.send_response(200)
            self.end_headers()
            if body["stream"]:
                self.wfile.write(b'data: {"choices": [{"delta": {"content": "ab"}}]}\n\ndata: {"choices": [{"delta": {"content": "c"}}], "usage": {"total_tokens": 2}}\n\ndata: [DONE]\n')
            else:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": "{}"}}], "usage": {"total_tokens": 5}}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = http_client.HttpClient(f"http://127.0.0.1:{server.server_port}/v1/", "m", "k")
    assert c.complete([{"role": "user", "content": "x"}]) == "{}"
    c.stream = True
    assert c.complete([{"role": "user", "content": "x"}]) == "abc" and c.usage == {"total_tokens": 7}
    assert seen[0][0] == "/v1/chat/completions" and seen[0][2] == "Bearer k"
    server.shutdown()


def proposal(nodes, mappings, summary="shorter"):
    return json.dumps({"outline_refined": {"nodes": [{"node_id": i, "title": x, "level": 1} for i, x in nodes]}, "node_mappings": [{"refined_node_id": r, "source_node_ids": s, "char_start": a, "char_end": b} for r, s, a, b in mappings], "change_summary": summary})


def test_refine_rounds(spark):
    rows = [(d, k, f"n{k}", f"Title {k} of {d}", 1, k * 10, k * 10 + 10) for d in ("one", "two", "three") for k in range(3)]
    outline = spark.createDataFrame(rows, "doc_id string, ord int, node_id string, title string, level int, char_start long, char_end long")
    good = proposal([("r1", "First"), ("r2", "Title 2 of one")], [("r1", ["n0", "n1"], 0, 20), ("r2", ["n2"], 20, 30)])
    gap = proposal([("r1", "First"), ("r2", "Rest")], [("r1", ["n0"], 0, 10), ("r2", ["n2"], 20, 30)])
    unknown = proposal([("r1", "All")], [("r1", ["n0", "n9"], 0, 30)], "")
    answers = {"Title 0 of one": good, "Title 0 of two": [unknown, "no json", good], "Title 0 of three": gap}

    def client():
        from foliant.operators import model_calls

        return model_calls.ScriptedClient(answers, "{}")

    got = refine.refine_round(outline, outline, client, "make it shorter")
    seen = {r["doc_id"]: r for r in got["preview"].collect()}
    assert seen["one"]["passed"] and seen["one"]["removed"] == ["Title 0 of one", "Title 1 of one"] and seen["one"]["added"] == ["First"]
    assert not seen["three"]["passed"] and seen["three"]["problems"] == ["gap: r2"] and seen["three"]["change_summary"] == "shorter"
    assert not seen["two"]["passed"] and seen["two"]["problems"] == ["unknown source: n9"] and seen["two"]["change_summary"] == "no summary"
    after = refine.accept(outline, got, spark.createDataFrame([("one",), ("three",)], "doc_id string"))
    taken = sorted(tuple(r) for r in after.where("doc_id = 'one'").collect())
    assert taken == [("one", 0, "r1", "First", 1, 0, 20), ("one", 1, "r2", "Title 2 of one", 1, 20, 30)]
    assert after.where("doc_id <> 'one'").count() == 6
    loose = refine.refine_round(outline, outline, client, "again", strict=False, retries=0)
    assert {r["doc_id"] for r in loose["preview"].where("passed").collect()} == {"one", "three"}


def test_prerequisites_that_fail(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    with pytest.raises(Exception, match="no directory: 2"):
        workspace.prerequisites(docs, docs.where("doc_id = 1"), {}, strict=True).collect()
    one = workspace.prerequisites(docs.where("doc_id = 1"), docs, {"brief": docs.limit(0)}, strict=True).collect()
    assert [tuple(r) for r in one] == [(1, True, False)]
