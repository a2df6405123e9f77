"""Scalar functions on hand-written cases."""

import pytest
from foliant.functions import text as t
from pyspark.sql import functions as F


def values(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_heading_lines(spark):
    cases = {"第一章 总则": (1, "总则"), "一、投标须知": (1, "一、投标须知"), "一、员工机制：": None, "1.2 范围": (2, "范围"), "1.2.3范围": (3, "范围"), "3. 概述": (1, "概述"), "7 概述": (1, "概述"), "7、条目": None, "名称：某公司": None, "": None, "  1.1  x  ": (2, "x"), "1. " + "长" * 51: None, "1. a: b": None, "x" * 121: None, "１.２ 宽": (2, "宽"), "十一、" + "长" * 60: None, "1.1 尾：": None, "普通文字": None, "1.1.1.1.1.1.1.1.1.1 deep": (8, "deep")}
    got = values(spark, list(cases), t.heading_line)
    assert [None if g is None else tuple(g) for g in got] == list(cases.values())


def test_lists(spark):
    assert values(spark, ["1、a", "名称：x", "一、名称：x", "", "x"], t.is_list_body) == [True, True, False, False, False]
    assert values(spark, ["一、机制：", "一、机制", "一、a：b"], t.is_local_enum) == [True, False, False]
    df = spark.createDataFrame([("正文", "一、"), ("1、正文", "一、"), ("1.1 标题", "(1)"), ("(1)正文", "(1)"), ("正文", None), (" ", "x")], "t string, p string")
    assert [r[0] for r in df.select(t.merge_list_prefix(F.col("t"), F.col("p"))).collect()] == ["一、正文", "1、正文", "1.1 标题", "(1)正文", "正文", ""]


def test_titles_and_refs(spark):
    assert values(spark, ["1.2 Scope ", "1、Scope", "3.Scope", "Scope 1", "  X  "], t.normalize_title) == ["scope", "scope", "scope", "scope 1", "x"]
    assert values(spark, ["<!-- table-ref:tables/t0001.json -->", "see ⟦table:abc⟧", "none", None], t.table_ref) == ["tables/t0001.json", "abc", None, None]
    assert values(spark, ["![a](x.png) ![b]( y ) ![c](x.png)"], t.distinct_image_refs) == [["x.png", "y"]]
    assert values(spark, ["/a/b.DOCX", "x.pdf", "x.docm", "x.txt", "noext"], t.file_type) == ["docx", "pdf", "docm", None, None]
    assert values(spark, ["（一）Ａｂ c(d)", "X  Y"], t.loose_title) == ["abc", "xy"]


@pytest.mark.parametrize(("n", "want"), [(0, "0"), (1, "一"), (10, "十"), (11, "十一"), (20, "二十"), (99, "九十九"), (100, "一百"), (101, "一百零一"), (110, "一百十"), (111, "一百十一"), (120, "一百二十"), (999, "九百九十九"), (1000, "1000"), (-3, "-3")])
def test_numbers(spark, n, want):
    from foliant.sources.docx import number_text

    assert values(spark, [n], t.chinese_number, "int") == [want]
    assert number_text(n, "chineseCounting") == want


def test_small_functions(spark):
    assert values(spark, ["abcd" * 3, "", "abc"], t.estimate_tokens) == [3, 0, 0]
    assert values(spark, [" a \t b\n", ""], t.normalize_ws) == ["a b", ""]
    assert values(spark, ["High", "low", "0.3", "7", "-1", "what", None], t.confidence) == [0.9, 0.5, 0.3, 1.0, 0.0, 0.8, 0.8]
    assert values(spark, [5.0, 2.5], t.weight_text, "double") == ["5", "2.5"]
    assert values(spark, ["一二三。四五六七八", "short", "aaaa bbbb cccc", "aaaaaaaaaaaaaaaa"], lambda c: t.limit_summary(c, 7)) == ["一二三。四五六", "short", "aaaa", "aaaaaaa"]
    df = spark.createDataFrame([("ab", "bc"), ("", ""), ("a", ""), ("aab", "ab")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(t.char_jaccard(F.col("a"), F.col("b"))).collect()] == [0.333333, 1.0, 0.0, 1.0]
    assert [r[0] for r in df.select(t.first_text(F.col("b"), F.col("a"))).collect()] == ["bc", t.MISSING, "a", "ab"]
    assert values(spark, ["分值 10", "1-5分", "nothing"], t.is_scoring_text) == [True, True, False]
