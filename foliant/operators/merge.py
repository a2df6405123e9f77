"""Order-aware dedupe and merging of extracted items. Rows carry ``ord``, which decides ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t

# Fixed value: the title of a requirement that is inferred.
INFERRED = "推断投标文件组成"


def dedupe_by_title(df: DataFrame, key: str = "doc_id", title: Column | str = "title", order: str = "ord", score: list[Column] | None = None) -> DataFrame:
    """Of rows with the same trimmed, lower-cased title, the best one (the first of equals), with ``out_ord``, its title's place.

    Blank titles never merge. One aggregation, so that many equal titles meet pre-aggregated.
    """
    own = F.lower(t.strip(F.col(title) if isinstance(title, str) else title))
    score = score or [F.coalesce("confidence", F.lit(0.0)), F.length(F.coalesce("source_excerpt", F.lit("")))]
    names = df.columns
    group = F.when(F.coalesce(own, F.lit("")) == "", F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(own)
    best = F.max_by(F.struct(*names), F.struct(*score, -F.col(order)))
    rows = df.groupBy(key, group.alias("_g")).agg(best.alias("_b"), F.min(order).alias("_first"))
    return rows.select(*[F.col(f"_b.{c}").alias(c) for c in names], (F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).alias("out_ord"))


def merge_scoring(df: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Scoring items with the same title and max_score as one: id, title and place of the first; texts of the best by
    confidence, then excerpt length; weight and section path the last non-empty among those that set a record; children united."""
    item = F.struct(F.col(order).alias("ord"), "id", "title", "max_score", "summary", "criteria", "weight", "section_path", "source_excerpt", "confidence", "children")
    rows = df.withColumn("_t", F.lower(t.strip(F.col("title")))).groupBy(key, "_t", "max_score").agg(F.array_sort(F.collect_list(item)).alias("items"))
    first = F.element_at("items", 1)

    def step(acc: Column, x: Column) -> Column:
        better = (x["confidence"] > acc["confidence"]) | ((x["confidence"] == acc["confidence"]) & (F.length(x["source_excerpt"]) > F.length(acc["source_excerpt"])))
        pick = lambda name: F.when(better, x[name]).otherwise(acc[name]).alias(name)
        return F.struct(acc["ord"].alias("ord"), acc["id"].alias("id"), acc["title"].alias("title"), acc["max_score"].alias("max_score"), pick("summary"), pick("criteria"), F.when(better & (F.coalesce(x["weight"], F.lit("")) != ""), x["weight"]).otherwise(acc["weight"]).alias("weight"), F.when(better & (F.size(x["section_path"]) > 0), x["section_path"]).otherwise(acc["section_path"]).alias("section_path"), pick("source_excerpt"), pick("confidence"), acc["children"].alias("children"))

    merged = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), first, step)
    rows = rows.select(key, merged.alias("m"), merge_children(F.flatten(F.transform("items", lambda x: x["children"]))).alias("kids"))
    fields = ["ord", "id", "title", "max_score", "summary", "criteria", "weight", "section_path", "source_excerpt", "confidence"]
    out = rows.select(key, *[F.col(f"m.{c}").alias(c) for c in fields], F.col("kids").alias("children"))
    return out.withColumn("out_ord", F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1)


def merge_children(children: Column) -> Column:
    """Of children (struct(title, criteria, source_excerpt)) with the same title, the one with the longest criteria, then
    excerpt (the first of equals), at its title's first place; blank titles never merge."""
    name = lambda x: F.lower(t.strip(x["title"]))
    size = lambda x: F.struct(F.length(F.coalesce(x["criteria"], F.lit(""))), F.length(F.coalesce(x["source_excerpt"], F.lit(""))))
    titles = F.array_distinct(F.filter(F.transform(children, name), lambda n: n != ""))
    best = F.transform(titles, lambda n: F.aggregate(F.filter(children, lambda x: name(x) == n), F.try_element_at(F.filter(children, lambda x: name(x) == n), F.lit(1)), lambda acc, x: F.when(size(x) > size(acc), x).otherwise(acc)))
    return F.concat(best, F.filter(children, lambda x: name(x) == ""))


def directory(df: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """(key, out_ord, title, inferred, sections, confidence): explicit requirements deduped by title, if a document has any;
    else all section titles, each once, as one inferred requirement of confidence 0.65 at most; else the items deduped.

    Rows: key, ord, title, inferred, sections array<string>, source_excerpt, confidence.
    """
    has = F.bool_or(~F.col("inferred") & (F.size("sections") > 0))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "sections"))), lambda x: x["sections"]))
    names = df.groupBy(key).agg(has.alias("_explicit"), flat.alias("_all"), F.max("confidence").alias("_sure"))
    trimmed = F.filter(F.transform("_all", t.strip), lambda x: x != "")
    low = F.transform(trimmed, F.lower)
    first = F.filter(F.transform(trimmed, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(low, F.lower(s["x"])) == s["i"] + 1)
    names = names.withColumn("_flat", F.transform(first, lambda s: s["x"]))
    rows = df.join(names.select(key, "_explicit", F.size("_flat").alias("_n")), key)
    kept = dedupe_by_title(rows.where("(_explicit and not inferred and size(sections) > 0) or (not _explicit and _n = 0)").drop("_explicit", "_n"), key, order=order)
    made = names.where("not _explicit and size(_flat) > 0").select(key, F.lit(0).alias("out_ord"), F.lit(INFERRED).alias("title"), F.lit(True).alias("inferred"), F.col("_flat").alias("sections"), F.least("_sure", F.lit(0.65)).alias("confidence"))
    return kept.select(key, "out_ord", "title", "inferred", "sections", "confidence").unionByName(made)


def dedupe_templates(df: DataFrame, key: str = "doc_id", same_title: float = 0.8, any_title: float = 0.9, prefix: int = 300) -> DataFrame:
    """Template hits, best confidence first, but those like one that is kept: letters' Jaccard of the texts' beginnings over
    ``same_title`` with the same loose title, or over ``any_title``. Not an equivalence, so a fold over a document's hits."""
    body = F.coalesce(F.nullif(t.strip(F.col("markdown")), F.lit("")), F.col("source_excerpt"), F.lit(""))
    hit = F.struct((-F.col("confidence")).alias("neg"), F.col("title").alias("title"), F.col("ord").alias("ord"), t.loose_title(F.col("title")).alias("loose"), F.array_distinct(F.filter(F.split(F.left(body, F.lit(prefix)), ""), lambda c: c != "")).alias("letters"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    none = F.filter("hits", lambda x: F.lit(False))

    def like(a: Column, b: Column) -> Column:
        both, either = F.size(F.array_intersect(a["letters"], b["letters"])), F.size(F.array_union(a["letters"], b["letters"]))
        near = F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))
        return ((a["loose"] == b["loose"]) & (near > same_title)) | ((F.size(a["letters"]) > 0) & (near > any_title))

    kept = F.aggregate("hits", none, lambda acc, x: F.when(F.exists(acc, lambda k: like(x, k)), acc).otherwise(F.concat(acc, F.array(x))))
    out = rows.select(key, F.explode(kept).alias("k")).select(key, "k.ord", "k.title", (-F.col("k.neg")).alias("confidence"))
    return out.withColumn("out_ord", F.row_number().over(Window.partitionBy(key).orderBy("title", "ord")) - 1)


def template_ids(df: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds type_id, numbered per type over non-empty templates, and template_id, numbered over all; empty ones go."""
    rows = df.withColumn("template_id", F.format_string("tpl-%03d", F.row_number().over(Window.partitionBy(key).orderBy(order)))).where(F.col("markdown").rlike(r"(?U)\S"))
    number = F.row_number().over(Window.partitionBy(key, "type").orderBy(order))
    return rows.withColumn("type_id", F.format_string("%s-%03d", F.col("type"), number))


def call_log(df: DataFrame, key: str = "call_key", order: str = "ord") -> DataFrame:
    """(key, prompt, response, attempts): per call the last prompt, the last response since that prompt, and all attempts; calls without a prompt go.

    Rows: key, ord, event (prompt, response or attempt), body.
    """
    is_ = lambda e: F.col("event") == e
    at = F.when(is_("prompt"), F.col(order))
    rows = df.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("asked"), F.max_by(F.when(is_("prompt"), F.col("body")), at).alias("prompt"), F.max(F.when(is_("response"), F.struct(F.col(order).alias("o"), F.col("body").alias("b")))).alias("r"), F.count_if(is_("attempt")).alias("attempts"))
    return rows.where("asked is not null").select(key, F.col("first").alias("ord"), "prompt", F.when(F.col("r.o") > F.col("asked"), F.col("r.b")).alias("response"), "attempts")
