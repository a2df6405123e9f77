"""Operators on hand-written cases, where the tables of the catalogue don't reach."""

import json
import random

import pytest
from foliant.operators import chunking, classify, merge, model_calls, outline, ranges, render, tables, tree, workspace
from pyspark.sql import functions as F


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_parent_is_the_nearest_smaller_level(spark):
    rng = random.Random(3)
    levels = [rng.randint(1, 8) for _ in range(200)]
    stack, want = [], []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        want.append(stack[-1] if stack else None)
        stack.append(i)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "doc_id int, ord int, level int")
    assert [r["parent_ord"] for r in outline.with_parent(df).orderBy("ord").collect()] == want


def test_greedy_parts(spark):
    text = "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(300)) + "y" * 900 + "\nend"
    want, size = [""], 0
    for line in text.splitlines(True):
        if size and (size + len(line)) // 4 > 100:
            want.append("")
            size = 0
        want[-1] += line
        size += len(line)
    df = spark.createDataFrame([(1, text), (2, ""), (3, "one")], "doc_id int, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", chunking.greedy_parts(F.col("text"), 100)).collect()}
    assert [p["text"] for p in got[1]] == want and got[2] == [] and [p["text"] for p in got[3]] == ["one"]
    assert all(text[p["start"] :].startswith(p["text"]) for p in got[1])


def test_break_windows(spark):
    df = spark.createDataFrame([(1, "a" * 30 + "\n\n" + "b" * 30 + "\n" + "c" * 60), (2, None), (3, " x ")], "doc_id int, text string")
    got = rows(chunking.break_windows(df, 50), "doc_id", "chunk", "text")
    assert got == [(1, 0, "a" * 30), (1, 1, "b" * 30), (1, 2, "c" * 49), (1, 3, "c" * 11), (3, 0, "x")]


def some_texts(n):
    rng = random.Random(n)
    signs = ["\n", "\n\n", "a", "bb", "ccc" * 7, " ", "\n \n", "\n\n\n"]
    return ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(n)]


def test_break_windows_on_any_text(spark):
    """Each piece, set in the text behind the one before, ends where the rule says."""
    texts = some_texts(300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for most in (7, 20, 50):
        got = {}
        for r in sorted(chunking.break_windows(df, most).collect()):
            got.setdefault(r["doc_id"], []).append(r["text"])
        for k, text in enumerate(texts):
            text, rest = text.strip(), list(got.get(k, []))
            while text:
                head = text[:most]
                if len(text) > most:
                    ends = [x for x in (head.rfind("\n\n"), head.rfind("\n")) if x > most // 2]
                    head = head[: ends[0]] if ends else head
                if head.strip():
                    assert rest.pop(0) == head.strip()
                text = text[len(head) :]
            assert not rest


def test_merge_small_like_joining_texts(spark):
    texts = some_texts(400)
    df = spark.createDataFrame([(k // 8, k, x) for k, x in enumerate(texts)], "doc_id int, ord int, text string")
    got = rows(chunking.merge_small(df, 6), "doc_id", "first", "last", "text")
    want = []
    for k, x in enumerate(texts):
        if want and want[-1][0] == k // 8 and len(want[-1][3]) // 4 < 6:
            d, first, _, before = want.pop()
            want.append((d, first, k, before.rstrip() + "\n\n" + x.lstrip()))
        else:
            want.append((k // 8, k, k, x))
    assert sorted(got) == sorted(want)


def test_section_paths_of_any_levels(spark):
    rng = random.Random(2)
    heads = [(k, o, rng.randint(1, 6), f"t{o}") for k in range(40) for o in range(rng.randint(1, 30))]
    df = spark.createDataFrame(heads, "doc_id int, ord int, level int, title string")
    got = {(r["doc_id"], r["ord"]): (r["path"], r["ancestors"]) for r in outline.section_paths(df).collect()}
    above = []
    for k, o, level, title in heads:
        above = [x for x in above if x[0] == k and x[2] < level] + [(k, o, level, title)]
        assert got[k, o] == ([x[3] for x in above], [x[1] for x in above])


def test_shards_cover_everything(spark):
    parts = [("# A\n" + "a" * 100, 1, 0), ("## B\n" + "b" * 300, 2, 1), ("## C\n" + "c" * 50, 2, 2), ("# D\n" + "d" * 900, 1, 3)]
    md, nodes = "preface ", []
    for p, level, i in parts:
        nodes.append((1, i, level, len(md)))
        md += p
    df = spark.createDataFrame([(1, md), (2, "short"), (3, "z" * 1000)], "doc_id int, content_md string")
    n = ranges.subtree_end(outline.with_parent(spark.createDataFrame(nodes, "doc_id int, ord int, level int, char_start long").withColumn("size", F.lit(len(md)).cast("long"))), "size")
    n = n.withColumn("own_end", F.coalesce(F.lead("char_start").over(__import__("pyspark").sql.Window.partitionBy("doc_id").orderBy("ord")), F.col("size")))
    got = chunking.shards(df, n, 400, 50).collect()
    covered = sorted((r["char_start"], r["char_end"]) for r in got if r["doc_id"] == 1)
    at = 0
    for s, e in covered:
        assert s <= at and e - s <= 400
        at = max(at, e)
    assert at == len(md)
    assert [(r["kind"], r["char_end"]) for r in got if r["doc_id"] == 2] == [("document", 5)]
    assert sum(r["doc_id"] == 3 for r in got) == 3


def test_anchors_move_off_images(spark):
    b = spark.createDataFrame([(1, 0, "image", "", 0, 5), (1, 1, "paragraph", "other words", 7, 18), (1, 2, "paragraph", "My title here", 20, 33), (1, 3, "heading", "Next", 35, 39)], "doc_id int, block_index int, block_type string, text string, char_start long, char_end long")
    n = spark.createDataFrame([(1, 0, "My title", 0), (1, 1, "Next", None)], "doc_id int, ord int, title string, block_start int")
    assert rows(outline.anchors(n, b), "ord", "block_index", "char_start") == [(0, 2, 20), (1, 3, 35)]


def test_enums_behind_a_local_list(spark):
    n = spark.createDataFrame([(1, 0, 1, "1 A", 0), (1, 1, 2, "1.1 B", 2), (1, 2, 1, "三、C", 9), (1, 3, 1, "四、D", 20)], "doc_id int, ord int, level int, title string, line_no int")
    lists = spark.createDataFrame([(1, 5)], "doc_id int, line_no int")
    assert rows(outline.relevel_enums(n, lists), "ord", "level") == [(0, 1), (1, 2), (2, 3), (3, 1)]


def test_excerpts(spark):
    df = spark.createDataFrame([("the quick brown fox jumps", "quick brown"), ("the quick brown fox jumps", "quick brown fox runs away"), ("abc", "zzz"), ("abc", " ")], "c string, e string")
    got = [r[0] and tuple(r[0]) for r in df.select(ranges.excerpt_range(F.col("c"), F.col("e"))).collect()]
    assert got == [(4, 15), (4, 20), None, None]
    p = spark.createDataFrame([("intro\n\nTitle one\n\nbody text\n\nlast", "Title")], "c string, t string")
    assert p.select(ranges.paragraph_excerpt(F.col("c"), F.col("t"), 12, 20)).first()[0] == "Title one\n\nbody text"


def test_refined_slices_and_mapping(spark):
    df = spark.createDataFrame([(1, "0123456789")], "doc_id int, content_md string")
    m = spark.createDataFrame([(1, 0, "a", 0, 4), (1, 1, "b", 4, 6), (1, 2, "c", 5, 99)], "doc_id int, ord int, refined_node_id string, char_start int, char_end int")
    assert rows(chunking.refined_slices(df, m), "ord", "markdown") == [(0, "0123"), (1, "45"), (2, "56789")]
    assert rows(workspace.mapping_problems(m), "refined_node_id", "problem") == [("c", "overlap")]


def test_classify_and_hints(spark):
    df = spark.createDataFrame([(1, "本项目采购方案要求与产品规格"), (2, "技术参数 产品能力"), (3, "nothing"), (4, "目录")], "id int, text string")
    got = {r["id"]: r for r in classify.classify(df).collect()}
    assert (got[1]["label"], round(got[1]["confidence"], 2), got[1]["rationale"]) == ("scheme", 0.85, "方案、采购、要求")
    assert got[2]["candidate_type"] == "product" and got[2]["hints"] == ["产品能力"]
    assert (got[3]["label"], got[3]["confidence"], got[3]["candidate_type"]) == ("other", 0.2, None)
    assert (got[4]["label"], got[4]["candidate_type"], got[4]["knowledge_type"]) == ("ignore", "ignore", None)
    merged = classify.merged_rules({"labels": {"a": 1, "b": 2}, "chapter_taxonomies": [1], "rules": [1]}, {"labels": {"b": 3}, "chapter_taxonomies": [9], "rules": [2]})
    assert merged == {"labels": {"a": 1, "b": 3}, "chapter_taxonomies": [9], "rules": [1, 2]}


def test_merge_scoring(spark):
    kid = "array<struct<title:string,criteria:string,source_excerpt:string>>"
    data = [(1, 0, "s1", " Price ", 30.0, "a", "", "w1", ["p"], "xx", 0.7, [("k1", "c", ""), ("", "z", "")]), (1, 1, "s2", "price", 30.0, "b", "cc", "", [], "x", 0.9, [("K1", "longer", ""), ("k2", "d", "")]), (1, 2, "s3", "Price", 20.0, "c", "", "", [], "", 0.9, [])]
    df = spark.createDataFrame(data, f"doc_id int, ord int, id string, title string, max_score double, summary string, criteria string, weight string, section_path array<string>, source_excerpt string, confidence double, children {kid}")
    got = merge.merge_scoring(df).orderBy("out_ord").collect()
    assert [(r["id"], r["title"], r["summary"], r["weight"], r["section_path"], r["confidence"]) for r in got] == [("s1", " Price ", "b", "w1", ["p"], 0.9), ("s3", "Price", "c", "", [], 0.9)]
    assert [(c["title"], c["criteria"]) for c in got[0]["children"]] == [("K1", "longer"), ("k2", "d"), ("", "z")]


def test_template_hits(spark):
    data = [(1, 0, "投标函（格式）", "abcdefghij", "", 0.9), (1, 1, "投标函", "abcdefghijk", "", 0.8), (1, 2, "别的", "abcdefghij", "", 0.7), (1, 3, "其它", "完全不同的内容", "", 0.6), (1, 4, "空", "", "", 0.5)]
    df = spark.createDataFrame(data, "doc_id int, ord int, title string, markdown string, source_excerpt string, confidence double")
    assert rows(merge.dedupe_templates(df), "ord") == [(0,), (3,), (4,)]
    ids = merge.template_ids(df.withColumn("type", F.lit("letter")))
    assert rows(ids, "template_id", "type_id") == [("tpl-001", "letter-001"), ("tpl-002", "letter-002"), ("tpl-003", "letter-003"), ("tpl-004", "letter-004")]


def test_tables(spark):
    person = [["姓名", "性别"], ["甲", "男"], ["级别", "年龄"], ["高级", "40"]]
    df = spark.createDataFrame([(1, person), (2, [["a", "b"], ["1", "2"]]), (3, [["姓名", "x"], [" 姓名 ", "y"]]), (4, [["a"]]), (5, [])], "id int, rows array<array<string>>")
    got = {r["id"]: r for r in tables.models(df).collect()}
    assert {k: r["layout"] for k, r in got.items()} == {1: "personnel_dual_row", 2: "simple", 3: "key_value", 4: "fallback"}
    pairs = lambda r: [[tuple(p) for p in rec] for rec in r["records"]]
    assert pairs(got[1]) == [[("姓名", "甲"), ("性别", "男"), ("级别", "高级"), ("年龄", "40")]]
    assert pairs(got[3]) == [[("姓名", "y")]]
    assert got[2]["markdown"] == "| a | b |\n| --- | --- |\n| 1 | 2 |" and got[4]["llm_text"] == "【表格:原始】\n行1: a"
    changed = spark.createDataFrame([([["a", "b"], ["1", "2"]], [[("b", "9")]])], "rows array<array<string>>, rec array<array<struct<key:string,value:string>>>")
    assert changed.select(tables.overlay(F.col("rows"), F.lit("simple"), F.col("rec"))).first()[0] == [["a", "b"], ["1", "9"]]


def test_outline_ids(spark):
    df = spark.createDataFrame([(1, 0, "bid-002"), (1, 1, None), (1, 2, "bid-002"), (1, 3, "x"), (2, 0, "bid-001")], "doc_id int, preorder int, given_id string")
    assert rows(workspace.outline_ids(df), "doc_id", "preorder", "node_id") == [(1, 0, "bid-002"), (1, 1, "bid-001"), (1, 2, "bid-003"), (1, 3, "bid-004"), (2, 0, "bid-001")]


def test_images_and_ocr(spark):
    e = spark.createDataFrame([(1, 0, "r2", 0), (1, 0, "r2", 1), (1, 1, "r1", 0), (1, 2, "r2", 0)], "doc_id int, paragraph int, rid string, pos int")
    assert rows(workspace.images(e), "paragraph", "rid", "file_name", "alt_no") == [(0, "r2", "docx-img-001", 1), (1, "r1", "docx-img-002", 2), (2, "r2", "docx-img-001", 3)]
    df = spark.createDataFrame([(1, "a\n![x](i.png)\nb")], "doc_id int, content_md string")
    cache = spark.createDataFrame([("i.png", "h1", "seen"), ("j.png", "h2", "")], "image_ref string, file_hash string, text string")
    assert workspace.with_ocr(df, cache).first()["content_md"] == "a\n![x](i.png)\n<!-- ocr:h1 -->\nseen\nb"


def test_model_calls(spark):
    client = model_calls.ScriptedClient({"bad": ["nope", "[1]", '{"a": 1}'], "never": "nope"})
    found, attempts = model_calls.extract_json(client, [{"role": "user", "content": "bad"}])
    assert found == {"a": 1} and [a.ok for a in attempts] == [False, False, True]
    found, attempts = model_calls.extract_json(client, [{"role": "user", "content": "never"}], retries=1)
    assert found is None and len(attempts) == 2
    found, _ = model_calls.extract_json(model_calls.ScriptedClient({"x": '{"a": 2}'}), [{"role": "user", "content": "x"}], check=lambda x: None if x["a"] == 1 else "a isn't 1")
    assert found is None

    def make():
        class Failing:
            def complete(self, messages):
                if "boom" in messages[-1]["content"]:
                    raise TimeoutError("late")
                kind = messages[-1]["content"].split("\n")[0]
                return json.dumps({"kind": kind})

        return Failing()

    df = spark.createDataFrame([(1, "fine"), (2, "boom"), (3, None)], "doc_id int, p string")
    got = {r["doc_id"]: r for r in model_calls.call(df, "p", make, "doc_id").collect()}
    assert got[1]["error"] is None and got[2]["error"] == "TimeoutError: late"
    texts = spark.createDataFrame([(1, "short"), (2, "x" * 100)], "doc_id int, text string")
    assert {r["doc_id"]: json.loads(r["answer"])["kind"] for r in model_calls.map_reduce(texts, "text", make, window=40).collect()} == {1: "SINGLE", 2: "MERGE"}


def test_scoring_segments(spark):
    s = spark.createDataFrame([(1, 0, 0, 100, "text")], "doc_id int, segment int, s int, e int, text string")
    tb = spark.createDataFrame([(1, f"t{i}", 200 + i, 210 + i, f"分值 {i}") for i in range(7)] + [(1, "far", 9999, 10000, "分值 far"), (1, "no", 50, 60, "other")], "doc_id int, table_ref string, char_start int, char_end int, llm_text string")
    assert chunking.scoring_lookahead(s, tb).first()["text"] == "text\n\n" + "\n\n".join(f"分值 {i}" for i in range(7))
    assert rows(chunking.scoring_segments(tb, s), "table_ref") == [(f"t{i}",) for i in range(5)]


def test_reports(spark):
    items = spark.createDataFrame([(1, 0, "A", 0, "x", "y"), (1, 0, "A", 1, "z", None)], "doc_id int, section_ord int, section string, ord int, title string, body string")
    assert render.report(items).first()["markdown"] == "# Report\n\n## A\n\n- **x**: y\n- **z**\n"
    assert rows(render.flat_directory(spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, preorder int")), "dir_id") == [("dir-001",), ("dir-002",)]


def test_progress(spark):
    df = spark.createDataFrame([(1, 3), (9, 3), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(workspace.progress(F.col("a"), F.col("b"))).collect()] == [33, 100, 0]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = spark.createDataFrame([(1, "text")], "doc_id int, text string").limit(n)
    assert chunking.linked(chunking.chunks(df)).count() == n
    assert tree.duplicate_anchors(df.withColumn("block_start", F.lit(None).cast("int"))).count() == 0


def test_template_kinds_and_scoring_paths(spark):
    df = spark.createDataFrame([("投标承诺书", "x"), ("附件", "授权委托"), ("函", "声明如下"), ("表", "")], "t string, m string")
    assert [r[0]["type"] for r in df.select(classify.template_kind(F.col("t"), F.col("m"))).collect()] == ["commitment", "authorization", "declaration", "other"]
    p = spark.createDataFrame([(["第三章", "评审办法"], "x"), (["投标人须知"], "x"), (["投标文件格式"], "【表格:列表】 分值")], "p array<string>, m string")
    got = [tuple(r) for r in p.select(classify.scoring_section(F.col("p")), classify.scoring_section(F.col("p"), True), classify.mixed_scoring_section(F.col("p"), F.col("m"))).collect()]
    assert got == [(True, True, False), (False, True, False), (False, False, True)]


def test_headings_matched_by_occurrence(spark):
    n = spark.createDataFrame([(1, 0, 1, "1. A", 5), (1, 1, 1, "A", 6), (1, 2, 2, "B", 7), (1, 3, 1, "gone", 8)], "doc_id int, ord int, level int, title string, char_start int")
    h = spark.createDataFrame([(1, 0, 1, "A", 100), (1, 1, 1, "a", 200), (1, 2, 3, "B", 300)], "doc_id int, ord int, level int, title string, char_start int")
    assert rows(outline.match_headings(n, h), "ord", "char_start") == [(0, 100), (1, 200), (2, 300), (3, 8)]


def test_located(spark):
    df = spark.createDataFrame([("ab cd ab", " ab ", 3), ("ab cd ab", "zz", 2)], "c string, p string, h int")
    assert [tuple(r[0]) for r in df.select(ranges.located(F.col("c"), F.col("p"), F.col("h"))).collect()] == [(6, 8), (2, 4)]
