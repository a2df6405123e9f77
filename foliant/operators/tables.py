"""Logical tables: array<array<string>> columns, their layout, records and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

# Words of personnel tables' heads, and marks of table texts.
PERSON = "姓名|性别|学历|角色|职务|岗位|本项目工作角色|人员|工号"
PERSON_MORE = "级别|年龄|毕业学校|从业年限|资质证书|职称|专业|工作年限"
MARKS = {"personnel_dual_row": "【表格:人员信息】", "simple": "【表格:列表】", "key_value": "【表格:键值】", "fallback": "【表格:原始】"}


def _ratio(row: Column, words: str) -> Column:
    return F.size(F.filter(row, lambda c: c.rlike(words))) / F.greatest(F.size(row), F.lit(1))


def layout(rows: Column) -> Column:
    """personnel_dual_row, simple, key_value or fallback."""
    n, width = F.size(rows), F.size(F.try_element_at(rows, F.lit(1)))
    even = F.forall(rows, lambda r: F.size(r) == width)
    quads = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(4))
    at = lambda k: F.coalesce(F.try_element_at(rows, k.cast("int")), F.array().cast("array<string>"))
    person = (n >= 4) & (n % 4 == 0) & even & F.forall(quads, lambda k: (_ratio(at(k), PERSON) >= 0.5) & (_ratio(at(k + 2), PERSON_MORE) >= 0.5))
    head = at(F.lit(1))
    simple = (n >= 2) & even & (_ratio(head, PERSON) < 0.5) & (_ratio(head, PERSON_MORE) < 0.5)
    return F.when(n <= 0, F.lit("fallback")).when(person, F.lit("personnel_dual_row")).when(simple, F.lit("simple")).when((width == 2) & (n >= 2), F.lit("key_value")).otherwise(F.lit("fallback"))


def _record(heads: Column, values: Column) -> Column:
    """Pairs of trimmed head and value, as long as the shorter; blank heads go, later values of a head replace earlier ones at its place."""
    n = F.least(F.size(heads), F.size(values))
    pairs = F.transform(F.arrays_zip(F.slice(heads, F.lit(1), n).alias("k"), F.slice(values, F.lit(1), n).alias("v")), lambda p: F.struct(t.strip(p["k"]).alias("key"), t.strip(p["v"]).alias("value")))
    return _deduped(F.filter(pairs, lambda p: p["key"] != ""))


def _deduped(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))


def records(rows: Column, kind: Column) -> Column:
    """array<array<struct(key, value)>>: the table's records, keys in order."""
    n = F.size(rows)
    empty = F.array().cast("array<string>")
    at = lambda k: F.coalesce(F.try_element_at(rows, k.cast("int")), empty)
    none = F.array().cast("array<array<struct<key:string,value:string>>>")
    quads = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(4))
    person = F.transform(quads, lambda k: _deduped(F.concat(_record(at(k), at(k + 1)), _record(at(k + 2), at(k + 3)))))
    simple = F.transform(F.slice(rows, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda r: _record(at(F.lit(1)), r))
    pairs = F.filter(F.transform(F.filter(rows, lambda r: F.size(r) >= 2), lambda r: F.struct(t.strip(r[0]).alias("key"), t.strip(r[1]).alias("value"))), lambda p: p["key"] != "")
    keyed = F.when(F.size(pairs) > 0, F.array(_deduped(pairs))).otherwise(none)
    return F.when(kind == "personnel_dual_row", person).when((kind == "simple") & (n >= 2), simple).when(kind == "key_value", keyed).otherwise(none)


def markdown(rows: Column) -> Column:
    """A pipe table; short rows are filled up."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) <= 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n"))


def llm_text(rows: Column, kind: Column, found: Column) -> Column:
    """The table as lines for a model, by layout."""
    pairs = lambda rec: F.transform(rec, lambda p: F.concat(p["key"], F.lit(": "), p["value"]))
    numbered = lambda mark: F.flatten(F.transform(found, lambda rec, i: F.concat(F.array(F.concat(F.lit(f"--- {mark} "), (i + 1).cast("string"), F.lit(" ---"))), pairs(rec))))
    raw = F.transform(rows, lambda r, i: F.concat(F.lit("行"), (i + 1).cast("string"), F.lit(": "), F.array_join(r, " | ")))
    made = lambda name, lines: F.array_join(F.concat(F.array(F.lit(MARKS[name])), lines), "\n")
    return F.when(kind == "personnel_dual_row", made("personnel_dual_row", numbered("记录"))).when(kind == "simple", made("simple", numbered("行"))).when(kind == "key_value", made("key_value", F.flatten(F.transform(found, pairs)))).otherwise(made("fallback", raw))


def models(df: DataFrame, rows: str = "rows") -> DataFrame:
    """Adds layout, records, markdown and llm_text to tables with cells; tables without rows go."""
    out = df.where(F.size(rows) > 0).withColumn("layout", layout(F.col(rows)))
    out = out.withColumn("records", records(F.col(rows), F.col("layout")))
    return out.withColumns({"markdown": markdown(F.col(rows)), "llm_text": llm_text(F.col(rows), F.col("layout"), F.col("records"))})


def overlay(rows: Column, kind: Column, found: Column) -> Column:
    """The cells with records' values put back where the layout has them."""
    value = lambda rec, head, old: F.coalesce(F.try_element_at(F.filter(rec, lambda p: p["key"] == t.strip(head)), F.lit(1))["value"], old)
    rec = lambda i: F.coalesce(F.try_element_at(found, i.cast("int")), F.array().cast("array<struct<key:string,value:string>>"))
    simple = F.transform(rows, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda c, j: value(rec(i), F.coalesce(F.get(rows[0], j), F.lit("")), c))))
    keyed = F.transform(rows, lambda r: F.when(F.size(r) >= 2, F.transform(r, lambda c, j: F.when(j == 1, value(rec(F.lit(1)), r[0], c)).otherwise(c))).otherwise(r))
    person = F.transform(rows, lambda r, i: F.when(i % 2 == 0, r).otherwise(F.transform(r, lambda c, j: value(rec(F.floor(i / 4) + 1), F.coalesce(F.get(F.get(rows, i - 1), j), F.lit("")), c))))
    return F.when(kind == "simple", simple).when(kind == "key_value", keyed).when(kind == "personnel_dual_row", person).otherwise(rows)
