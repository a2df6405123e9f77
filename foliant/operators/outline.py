"""Heading outlines: rows (key, ord, level 1..8, title, ...), one per heading in document order."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t

LEVELS = range(1, 9)


def headings(df: DataFrame, key: str = "doc_id", text: str = "content_md") -> DataFrame:
    """(key, ord, level, title, char_start): the Markdown headings of a text."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))
    level, title = F.length(F.regexp_extract("line", t.HEADING, 1)), F.regexp_extract("line", t.HEADING, 2)
    found = rows.where(F.col("line").rlike(t.HEADING)).where(t.strip(title) != "")
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1).alias("ord"), level.alias("level"), t.strip(title).alias("title"), "char_start")


def with_parent(df: DataFrame, key: str = "doc_id", order: str = "ord", level: str = "level", out: str = "parent_ord") -> DataFrame:
    """Adds the nearest heading before with a smaller level: for each level the last such heading, then the latest of the smaller ones."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before)) for k in LEVELS]
    return df.withColumn(out, F.greatest(*last))


def section_paths(df: DataFrame, key: str = "doc_id", order: str = "ord", level: str = "level", title: str = "title") -> DataFrame:
    """(key, ord, path, ancestors): titles and ords from the root down to the node.

    Of each smaller level, the last heading before is an ancestor if no heading of a level smaller still came later: one window.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(title).alias("x"))), ignorenulls=True).over(before)).alias(f"_{k}") for k in LEVELS]
    rows = df.select(key, F.col(order).alias("n"), F.col(title).alias("x"), *last)
    later = lambda k: F.greatest(*[F.col(f"_{j}.o") for j in range(1, k)], F.lit(-1), F.lit(-1))
    holds = [F.when(F.col(f"_{k}.o") > later(k), F.col(f"_{k}")) for k in LEVELS]
    chain = F.concat(F.array_compact(F.array(*holds)), F.array(F.struct(F.col("n").alias("o"), "x")))
    return rows.select(key, F.col("n").alias(order), chain.alias("c")).select(key, order, F.col("c.x").alias("path"), F.col("c.o").alias("ancestors"))


def paths_by_title(df: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """(key, title, path): the first node's path for each title."""
    return df.groupBy(key, "title").agg(F.min_by("path", order).alias("path"))


def plain_headings(df: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, line_no, level, title) of numbered headings in line rows; 一、 lines inside a local list are none.

    A local list is open at a line if the last line that opened one is later than the last that ended it.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    opens, enum = t.is_local_enum(F.col(line)), t.is_enum_line(F.col(line))
    rows = df.select(key, order, t.heading_line(F.col(line)).alias("h"), opens.alias("opens"), enum.alias("enum"))
    rows = rows.withColumns({"opened": F.last(F.when(F.col("opens"), F.col(order)), ignorenulls=True).over(before), "ended": F.last(F.when(F.col("h").isNotNull() & ~F.col("opens") & ~F.col("enum"), F.col(order)), ignorenulls=True).over(before)})
    inside = F.col("opened") > F.coalesce("ended", F.lit(-1))
    kept = rows.where(F.col("h").isNotNull() & ~F.col("opens") & ~(F.coalesce(inside, F.lit(False)) & F.col("enum")))
    return kept.select(key, order, "h.level", "h.title", F.coalesce(inside, F.lit(False)).alias("inside"))


def flat(df: DataFrame, key: str = "doc_id", title: Column | None = None) -> DataFrame:
    """One node for documents without any heading."""
    return df.select(key, F.lit(0).alias("ord"), F.lit(1).alias("level"), (title if title is not None else F.lit("Document")).alias("title"), F.lit(True).alias("needs_review"))


def first_strategy(strategies: list[tuple[str, DataFrame]], key: str = "doc_id") -> DataFrame:
    """Of several outlines (key, ord, level, title), for each document the nodes of the first that has any."""
    parts = [df.select(key, "ord", "level", "title", F.lit(k).alias("priority"), F.lit(name).alias("strategy")) for k, (name, df) in enumerate(strategies)]
    rows = functools.reduce(DataFrame.unionByName, parts)
    best = rows.groupBy(key).agg(F.min("priority").alias("best"))
    return rows.join(best, key).where("priority = best").drop("priority", "best")


def block_of_title(nodes: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, block_index): the first text block whose normalised text equals, holds or is held by the node's title.

    ``blocks`` has key, block_index, block_type, text; blank texts match nothing.
    """
    b = blocks.where(F.col("block_type").isin("paragraph", "heading")).select(key, "block_index", t.normalize_title(F.col("text")).alias("bt")).where("bt <> ''")
    n = nodes.select(key, "ord", t.normalize_title(F.col("title")).alias("nt")).where("nt <> ''")
    return n.join(b, key).where(F.contains("bt", F.col("nt")) | F.contains("nt", F.col("bt"))).groupBy(key, "ord").agg(F.min("block_index").alias("block_index"))


def anchors(nodes: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds block_index, char_start, char_end to nodes: by their own block, else by title; one on an image or table
    moves on to the next text block before the next node's block, one that has the title first."""
    matched = block_of_title(nodes, blocks, key).withColumnRenamed("block_index", "by_title")
    rows = nodes.join(matched, [key, "ord"], "left")
    at = blocks.select(F.col(key).alias("_key"), F.col("block_index").alias("own"), F.col("block_type").alias("own_type"))
    rows = rows.join(at, (F.col(key) == F.col("_key")) & (F.col("block_start") == F.col("own")), "left").drop("_key")
    rows = rows.withColumn("at", F.coalesce("own", "by_title"))
    rows = rows.withColumn("until", F.lead("at").over(Window.partitionBy(key).orderBy("ord")))
    texts = blocks.where(F.col("block_type").isin("paragraph", "heading")).select(F.col(key).alias("k2"), F.col("block_index").alias("next"), t.normalize_title(F.col("text")).alias("bt"))
    off = rows.where(~F.col("own_type").isin("paragraph", "heading"))
    moved = off.join(texts, (F.col(key) == F.col("k2")) & (F.col("next") > F.col("at")) & (F.col("until").isNull() | (F.col("next") < F.col("until"))))
    nt = t.normalize_title(F.col("title"))
    fits = ((F.contains("bt", nt) | F.contains(nt, F.col("bt"))) & (F.col("bt") != "")).cast("int")
    moved = moved.groupBy(key, "ord").agg(F.min_by("next", F.struct(1 - fits, F.col("next"))).alias("moved"))
    rows = rows.join(moved, [key, "ord"], "left").withColumn("block_index", F.coalesce("moved", "at")).drop("own", "own_type", "at", "until", "by_title", "moved")
    return rows.join(blocks.select(key, "block_index", "char_start", "char_end"), [key, "block_index"], "left")


def relevel_enums(nodes: DataFrame, local_lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """Level-1 一、 nodes behind a local list that began since the previous node go under the nearest numbered
    section of level 2 or more, a level deeper. ``nodes`` has line_no; ``local_lists`` (key, line_no)."""
    w = Window.partitionBy(key).orderBy("ord")
    rows = nodes.withColumn("prev_line", F.coalesce(F.lag("line_no").over(w), F.lit(-1)))
    lists = local_lists.select(F.col(key).alias("k2"), F.col("line_no").alias("list_line"))
    hit = rows.where((F.col("level") == 1) & t.is_enum_line(F.col("title"))).join(lists, (F.col(key) == F.col("k2")) & (F.col("list_line") > F.col("prev_line")) & (F.col("list_line") < F.col("line_no")), "left_semi").select(key, "ord", F.lit(True).alias("local"))
    deep = F.last(F.when((F.col("level") >= 2) & ~t.is_enum_line(F.col("title")), F.col("level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("deep", deep).join(hit, [key, "ord"], "left")
    return rows.withColumn("level", F.when(F.col("local") & F.col("deep").isNotNull(), F.least(F.col("deep") + 1, F.lit(8))).otherwise(F.col("level"))).drop("prev_line", "deep", "local")


def match_headings(nodes: DataFrame, heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes with the start of their heading in the text: the one of the same level, title and occurrence; else the
    first of that title; else the node's own anchor. Both have key, ord, level, title, char_start."""
    same = Window.partitionBy(key, "level", "nt").orderBy("ord")
    n = nodes.withColumn("nt", t.normalize_title(F.col("title"))).withColumn("k", F.row_number().over(same))
    h = heads.withColumn("nt", t.normalize_title(F.col("title"))).withColumn("k", F.row_number().over(same))
    first = h.groupBy(key, "nt").agg(F.min("char_start").alias("by_title"))
    exact = h.select(key, "level", "nt", "k", F.col("char_start").alias("exact"))
    both = n.join(exact, [key, "level", "nt", "k"], "left").join(first, [key, "nt"], "left")
    return both.withColumn("char_start", F.coalesce("exact", "by_title", "char_start")).drop("nt", "k", "exact", "by_title")
