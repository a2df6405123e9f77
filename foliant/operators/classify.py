"""Rule-based labels: keyword counts, aliases, candidate types, routes. Rule tables are parameters of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels, their names and keywords, in order.
LABELS = [
    ("scheme", "政策方案", ["政策", "方案", "采购", "招标", "要求"]),
    ("product", "产品能力", ["产品", "设备", "技术参数", "功能", "规格"]),
    ("qualification", "资质证明", ["资质", "证书", "业绩", "经验", "团队"]),
    ("other", "其他", []),
    ("ignore", "忽略", ["目录", "封面", "封皮"]),
]
# Hints and their aliases, in order.
HINTS = [
    ("技术方案", ["技术方案", "系统设计", "实施方案", "系统架构"]),
    ("资质证明", ["资质", "资格", "业绩证明", "公司业绩"]),
    ("服务方案", ["服务承诺", "应急预案", "食品安全", "服务方案"]),
    ("产品能力", ["产品", "功能", "技术参数", "产品能力"]),
    ("目录", ["目录", "封面", "封皮"]),
]
# Hints to candidate and knowledge types, in order.
CANDIDATES = [
    (["技术方案", "实施方案", "系统设计"], "scheme", "scheme"),
    (["产品能力", "技术参数"], "product", "product"),
    (["资质证明", "资格文件"], "qualification", "qualification"),
    (["目录", "封面"], "ignore", None),
]
# Routes to sections by words of their titles.
ROUTES = {
    "legal_risk": ["合同", "通用条款", "违约责任", "付款", "争议", "知识产权"],
    "pending": ["待定", "另行", "协商", "以...为准", "不明确"],
}

# Kinds of templates, their names and words, in order; words of titles with templates; words of scoring sections.
TEMPLATES = [("commitment", "承诺书", ["承诺书", "承诺"]), ("authorization", "授权书", ["授权"]), ("declaration", "声明函", ["声明"])]
TEMPLATE_TITLES = ["附件", "承诺书", "授权", "声明", "委托"]
SCORING = ["评分", "评审办法", "评标", "评审", "分值", "得分"]
SCORING_HOSTS = ["响应人须知", "投标人须知", "供应商须知", *SCORING]
FORMAT_PATHS = ["格式", "响应文件", "投标文件组成"]
TABLE_MARK, SCORING_HINTS = "【表格:", ["评分说明", "分值", "得分"]


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def match_rule(text: Column, labels: list[tuple[str, str, list[str]]] = LABELS) -> Column:
    """struct(label, chapter_type, confidence, rationale): the label with most keywords in the text (the first of equals); null if none has any."""
    low = F.lower(text)
    scored = []
    for k, (label, chapter, words) in enumerate(labels):
        hits = F.filter(_words([w.lower() for w in words]), lambda w: F.contains(low, w))
        sure = F.least(F.lit(0.99), F.lit(0.55) + F.size(hits) * 0.1)
        scored.append(F.struct(sure.alias("confidence"), F.lit(-k).alias("order"), F.lit(label).alias("label"), F.lit(chapter).alias("chapter_type"), F.size(hits).alias("hits"), F.array_join(F.slice(hits, 1, 3), "、").alias("rationale")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, F.struct(best["label"].alias("label"), best["chapter_type"].alias("chapter_type"), best["confidence"].alias("confidence"), best["rationale"].alias("rationale"))) if labels else F.lit(None)


def hints(text: Column, table: list[tuple[str, list[str]]] = HINTS) -> Column:
    """The hints any of whose aliases the text holds, in the table's order."""
    found = [F.when(F.exists(_words(a), lambda w: F.contains(text, w)), F.lit(h)) for h, a in table]
    return F.array_distinct(F.array_compact(F.array(*found)))


def candidate_type(found: Column, table: list[tuple[list[str], str, str | None]] = CANDIDATES) -> Column:
    """struct(candidate, knowledge) of the first rule that shares a hint; null if none does."""
    return F.coalesce(*[F.when(F.arrays_overlap(found, _words(h)), F.struct(F.lit(c).alias("candidate"), F.lit(k).cast("string").alias("knowledge"))) for h, c, k in table])


def classify(df: DataFrame, text: str = "text", labels=LABELS, hint_table=HINTS, candidates=CANDIDATES, model: Column | None = None) -> DataFrame:
    """Adds label, chapter_type, confidence, hints, candidate and knowledge type; by rule, else by ``model`` (a struct of that form), else other at 0.2.

    A hint's types replace those that the label itself would give.
    """
    default = F.struct(F.lit("other").alias("label"), F.lit("其他").alias("chapter_type"), F.lit(0.2).alias("confidence"), F.lit("").alias("rationale"))
    rows = df.withColumn("_m", F.coalesce(*[x for x in (match_rule(F.col(text), labels), model, default) if x is not None])).withColumn("hints", hints(F.col(text), hint_table))
    rows = rows.withColumn("_c", candidate_type(F.col("hints"), candidates))
    direct = F.when(F.col("_m.label").isin("scheme", "product", "qualification"), F.col("_m.label"))
    return rows.withColumns({"label": F.col("_m.label"), "chapter_type": F.col("_m.chapter_type"), "confidence": F.col("_m.confidence"), "rationale": F.col("_m.rationale"), "candidate_type": F.coalesce("_c.candidate", direct, F.when(F.col("_m.label") == "ignore", F.lit("ignore"))), "knowledge_type": F.coalesce("_c.knowledge", direct)}).drop("_m", "_c")


def route(df: DataFrame, words: list[str], title: str = "title") -> DataFrame:
    """The rows whose title holds any of the words."""
    return df.where(F.exists(_words(words), lambda w: F.contains(F.col(title), w)))


def merged_rules(base: dict, more: dict) -> dict:
    """Rule sets: labels merge by name, lists of hints are replaced, candidate rules are appended."""
    out = dict(base)
    out["labels"] = {**base.get("labels", {}), **more.get("labels", {})}
    for name in ("chapter_taxonomies", "product_categories"):
        if more.get(name):
            out[name] = more[name]
    out["rules"] = [*base.get("rules", []), *more.get("rules", [])]
    return out


def holds_any(text: Column, words: list[str]) -> Column:
    return F.exists(_words(words), lambda w: F.contains(text, w))


def template_kind(title: Column, markdown: Column, seen: int = 500) -> Column:
    """struct(type, type_label, confidence) by words in the title and the text's beginning."""
    text = F.concat_ws("\n", title, F.left(markdown, F.lit(seen)))
    made = lambda kind, label, sure: F.struct(F.lit(kind).alias("type"), F.lit(label).alias("type_label"), F.lit(sure).alias("confidence"))
    return F.coalesce(*[F.when(holds_any(text, words), made(kind, label, 0.95)) for kind, label, words in TEMPLATES], made("other", "其他", 0.6))


def scoring_section(path: Column, hosts: bool = False) -> Column:
    """Whether a section path (array of titles) is about scoring; with ``hosts``, or may hold scoring tables."""
    return holds_any(F.array_join(path, " "), SCORING_HOSTS if hosts else SCORING)


def mixed_scoring_section(path: Column, markdown: Column) -> Column:
    """Whether a section on formats holds a scoring table."""
    return holds_any(F.array_join(path, " "), FORMAT_PATHS) & F.contains(markdown, F.lit(TABLE_MARK)) & holds_any(markdown, SCORING_HINTS)
