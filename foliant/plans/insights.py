"""Jobs that extract items from documents with a model: segments out, answers in, items merged, anchored, reported.

A client factory is a parameter; answers are JSON objects. Keys are documents or workspaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import chunking, merge, model_calls, ranges, tree, workspace
from foliant.session import checkpoint

#: Lists in an answer, and what their items have.
ITEMS = {
    "qualifications": "title: string, summary: string, trigger_condition: string, source_excerpt: string, confidence: string",
    "scoring": "title: string, max_score: double, summary: string, criteria: string, weight: string, source_excerpt: string, confidence: string, children: array<struct<title: string, criteria: string, source_excerpt: string>>",
    "risks": "title: string, summary: string, severity: string, source_excerpt: string, confidence: string",
    "directory": "title: string, inferred: boolean, sections: array<string>, source_excerpt: string, confidence: string",
}


def segments(df: DataFrame, key: str = "doc_id", text: str = "content_md", least: int = 2000, most: int = 12_000) -> DataFrame:
    """(key, segment_id, ordinal, text, char_start): the text's heading sections, small ones merged, large ones split."""
    lines = df.select(key, F.posexplode(F.split(text, r"(?<=\n)")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("section", F.sum(F.col("line").rlike(t.HEADING).cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "")
    parts = cut.groupBy(key, "section").agg(joined.alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    merged = chunking.merge_small(parts, least, key, "section")
    split = chunking.split_large(merged, most, key)
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("segment", "part")) - 1
    placed = split.withColumn("ordinal", number).join(body, F.col(key) == F.col("k2"))
    at = F.instr("content", F.left(t.strip(F.col("text")), F.lit(120)))
    return placed.select(key, F.format_string("seg-%03d", "ordinal").alias("segment_id"), "ordinal", "text", F.when(at > 0, at - 1).alias("char_start"))


def answers(segs: DataFrame, client: Callable, key: str, system: str = "") -> DataFrame:
    asked = segs.withColumn("call_id", F.concat_ws("\0", F.col(key).cast("string"), F.lpad("ordinal", 9, "0"))).withColumn("prompt", F.concat(F.lit("Segment "), "segment_id", F.lit("\n\n"), "text"))
    got = model_calls.call(asked, "prompt", client, "call_id", system)
    return asked.select(key, "ordinal", "call_id").join(got, "call_id").drop("call_id")


def items(found: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """(key, ord, ...): one kind's items in order of segment and place, confidence as a number, texts filled in."""
    parsed = F.from_json("answer", f"struct<{kind}: array<struct<{ITEMS[kind]}>>>")[kind]
    rows = found.where("answer is not null").select(key, "ordinal", F.posexplode(parsed).alias("place", "x")).select(key, "ordinal", "place", "x.*")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "place")) - 1)
    rows = rows.withColumns({"confidence": t.confidence(F.col("confidence")), "title": t.first_text(F.col("title")), "source_excerpt": F.coalesce("source_excerpt", F.lit(""))})
    return rows.withColumn("severity", F.lower(t.strip(F.coalesce("severity", F.lit("medium"))))) if kind == "risks" else rows


def anchored(rows: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "content_md", excerpt: Column | None = None) -> DataFrame:
    """Items with the range of their excerpts in the text."""
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    both = rows.join(body, F.col(key) == F.col("k2"), "left").withColumn("r", ranges.excerpt_range(F.col("content"), excerpt if excerpt is not None else F.col("source_excerpt")))
    return both.withColumns({"char_start": F.col("r.char_start"), "char_end": F.col("r.char_end")}).drop("k2", "content", "r")


def interpret(df: DataFrame, client: Callable, key: str = "doc_id", text: str = "content_md", system: str = "") -> dict[str, DataFrame]:
    """The four kinds of items, merged over segments and anchored, and the calls (answers, attempts, errors)."""
    found = checkpoint(answers(segments(df, key, text), client, key, system))  # a call is paid for once
    scoring = items(found, "scoring", key)
    empty = F.array().cast("array<string>")
    scoring = scoring.select(key, "ord", F.format_string("si-%03d", F.col("ord") + 1).alias("id"), "title", "max_score", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("criteria", F.lit("")).alias("criteria"), t.weight_text(F.coalesce("weight", F.lit(""))).alias("weight"), empty.alias("section_path"), "source_excerpt", "confidence", F.coalesce("children", F.array().cast("array<struct<title:string,criteria:string,source_excerpt:string>>")).alias("children"))
    directory = items(found, "directory", key).withColumns({"inferred": F.coalesce("inferred", F.lit(False)), "sections": F.coalesce("sections", empty)})
    return {
        "qualifications": anchored(merge.dedupe_by_title(items(found, "qualifications", key), key), df, key, text),
        "scoring": anchored(merge.merge_scoring(scoring, key), df, key, text),
        "risks": anchored(merge.dedupe_by_title(items(found, "risks", key), key), df, key, text),
        "directory": merge.directory(directory, key),
        "calls": found,
    }


def overview(merged: dict[str, DataFrame], client: Callable, key: str = "doc_id") -> DataFrame:
    """(key, answer): one call per document over the titles of all its items."""
    parts = [merged[k].select(key, F.lit(k).alias("kind"), "out_ord", "title") for k in ("qualifications", "scoring", "risks", "directory")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    asked = rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "out_ord", "title")))).alias("prompt"))
    return model_calls.call(asked.withColumn("prompt", F.concat(F.lit("OVERVIEW\n"), "prompt")), "prompt", client, key)


def brief(df: DataFrame, client: Callable, key: str = "doc_id", text: str = "content_md", window: int = 20_000, summary: int = 500) -> DataFrame:
    """(key, answer, summary): facts of whole documents, window by window; the summary cut to its limit."""
    got = model_calls.map_reduce(df, text, client, key, window)
    return got.withColumn("summary", t.limit_summary(F.coalesce(F.get_json_object("answer", "$.summary"), F.lit("")), summary))


def templates(df: DataFrame, nodes: DataFrame, client: Callable, key: str = "doc_id", text: str = "content_md", size: int = 6000, overlap: int = 500) -> DataFrame:
    """Templates found shard by shard (a shard whose call fails has none), deduped, numbered."""
    cut = chunking.shards(df, nodes, size, overlap, key, text)
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("char_start", "char_end")) - 1
    rows = cut.withColumn("ordinal", number).join(body, F.col(key) == F.col("k2")).select(key, "ordinal", F.format_string("shard-%03d", "ordinal").alias("segment_id"), F.substring("content", (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")).alias("text"))
    found = answers(rows, client, key)
    parsed = F.from_json("answer", "struct<templates: array<struct<title: string, type: string, markdown: string, source_excerpt: string, confidence: string>>>")["templates"]
    hits = found.where("answer is not null").select(key, "ordinal", F.posexplode(parsed).alias("place", "x")).select(key, "ordinal", "place", "x.*")
    hits = hits.withColumns({"ord": F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "place")) - 1, "confidence": t.confidence(F.col("confidence")), "source_excerpt": F.coalesce("source_excerpt", F.lit("")), "type": F.coalesce("type", F.lit("other"))})
    kept = merge.dedupe_templates(hits, key).select(key, "ord", "out_ord")
    return merge.template_ids(hits.join(kept, [key, "ord"]), key, "out_ord")


def legal(df: DataFrame, nodes: DataFrame, client: Callable, words: list[str], key: str = "doc_id", text: str = "content_md") -> DataFrame:
    """Items from the sections whose titles hold a route's words, deduped by description, anchored."""
    hit = nodes.where(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("title", w)))
    body = df.select(F.col(key).alias("k2"), F.col(text).alias("content"))
    cut = F.substring("content", (F.col("char_start") + 1).cast("int"), (F.col("same_level_end") - F.col("char_start")).cast("int"))
    rows = hit.join(body, F.col(key) == F.col("k2")).select(key, F.col("ord").alias("ordinal"), F.concat(F.lit("node "), F.col("ord").cast("string")).alias("segment_id"), model_calls.section_prompt(F.col("title"), cut).alias("text"))
    found = answers(rows, client, key)
    parsed = F.from_json("answer", "struct<items: array<struct<description: string, source_excerpt: string, confidence: string>>>")["items"]
    items_ = found.where("answer is not null").select(key, "ordinal", F.posexplode(parsed).alias("place", "x")).select(key, "ordinal", "place", "x.*")
    items_ = items_.withColumns({"ord": F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "place")) - 1, "confidence": t.confidence(F.col("confidence")), "source_excerpt": F.coalesce("source_excerpt", F.lit(""))})
    excerpt = F.coalesce(F.nullif("source_excerpt", F.lit("")), F.col("description"))
    return anchored(merge.dedupe_by_title(items_, key, "description"), df, key, text, excerpt)


def bid_outline(nodes: DataFrame, client: Callable, key: str = "doc_id") -> DataFrame:
    """An outline refined chapter by chapter: each round, every document's next pending chapter gets one call whose ``children``
    become its sections, until no chapter is pending. Resumable: nodes are marked done. Rows: key, ord, node_id, parent_id, title, done."""
    while True:
        queue = nodes.where("parent_id is null and not done")
        if queue.isEmpty():
            return nodes
        ahead = workspace.next_pending(queue, nodes.where("done"), key).withColumnRenamed("node_id", "next_id")
        asked = nodes.join(ahead.withColumnRenamed(key, "k2"), (F.col(key) == F.col("k2")) & (F.col("node_id") == F.col("next_id"))).select(key, "node_id", F.concat(F.lit("CHAPTER\n"), "title").alias("prompt"))
        got = model_calls.call(asked, "prompt", client, key).join(asked.select(key, "node_id"), key)
        kids = got.select(key, "node_id", F.posexplode(F.from_json("answer", "struct<children: array<string>>")["children"]).alias("i", "title"))
        made = kids.select(key, F.col("i").alias("ord"), F.concat_ws("-", "node_id", (F.col("i") + 1).cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"), "title", F.lit(True).alias("done"))
        marked = nodes.join(ahead.withColumnRenamed(key, "k2"), (F.col(key) == F.col("k2")) & (F.col("node_id") == F.col("next_id")), "left").select(key, "ord", "node_id", "parent_id", "title", (F.col("done") | F.col("next_id").isNotNull()).alias("done"))
        nodes = checkpoint(marked.unionByName(made))


def pipeline(df: DataFrame, key: str = "doc_id", text: str = "content_md", max_tokens: int = 20_000) -> dict[str, DataFrame]:
    """Outline, tree, chunks and links of Markdown texts, without any model."""
    from foliant.operators import blocks, outline

    heads = outline.with_parent(outline.headings(df, key, text), key)
    size = df.select(F.col(key).alias("k2"), F.length(text).cast("long").alias("size"))
    nodes = ranges.subtree_end(heads.join(size, F.col(key) == F.col("k2")).drop("k2"), "size", key)
    nodes = nodes.withColumn("own_end", F.coalesce(F.lead("char_start").over(Window.partitionBy(key).orderBy("ord")), F.col("size")))
    lines = blocks.lines(df, key, text).where(F.col("line").rlike(r"(?U)\S"))
    w = Window.partitionBy(key).orderBy("line_no")
    found = lines.withColumns({"block_index": F.row_number().over(w) - 1, "block_type": F.when(F.col("line").rlike(t.HEADING), F.lit("heading")).otherwise(F.lit("paragraph"))})
    number = F.row_number().over(Window.partitionBy(key).orderBy("block_index")) - 1
    starts = found.where("block_type = 'heading'").select(key, number.alias("ord"), F.col("block_index").alias("block_start"))
    nodes = nodes.join(starts, [key, "ord"], "left")
    parts = chunking.chunks(chunking.sections(df, nodes, key, text), key, "ord", "markdown", max_tokens)
    chunk = chunking.linked(parts, key).withColumns({"node_ord": F.col("section"), "heading_level": F.when((F.col("part") == 0) & (F.col("section") >= 0), F.lit(1))})
    tree_nodes = tree.tree(found.select(key, "block_index", "block_type"), nodes, key)
    return {"outline": nodes, "blocks": found, "tree": tree_nodes, "chunks": chunk, "linkage": tree.linkage(nodes, tree_nodes, chunk, key)}
