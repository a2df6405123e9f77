"""Document trees: heading and text nodes from blocks and an outline; links between outline, tree and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.outline import with_parent


def tree(blocks: DataFrame, outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sort_order, node_id, parent_id, node_type, level, title, block_index, outline_ord).

    A text block at which an outline node starts is that node's heading (the last node, where several start); a heading that the
    outline lacks is a paragraph. Other blocks hang on the heading before them. Outline nodes without a
    heading get one: behind the headings of their block, else before the first other block from there on, else at
    the end. Headings hang as the outline says.
    """
    at = outline.where("block_start is not null").groupBy(key, F.col("block_start").alias("block_index")).agg(F.max_by(F.struct("ord", "level", "title"), "ord").alias("o"))
    rows = blocks.join(at, [key, "block_index"], "left")
    is_heading = F.col("o").isNotNull() & F.col("block_type").isin("heading", "paragraph")
    made = rows.select(key, "block_index", F.when(is_heading, F.lit(0)).otherwise(F.lit(2)).alias("class"), F.when(is_heading, F.col("o.ord")).alias("outline_ord"), F.when(is_heading, F.lit("heading")).when(F.col("block_type") == "heading", F.lit("paragraph")).otherwise(F.col("block_type")).alias("node_type"), F.when(is_heading, F.col("o.level")).alias("level"), F.when(is_heading, F.col("o.title")).alias("title"))
    have = made.where("outline_ord is not null").select(F.col(key).alias("k2"), F.col("outline_ord").alias("o2"))
    missing = outline.join(have, (F.col(key) == F.col("k2")) & (F.col("ord") == F.col("o2")), "left_anti")
    added = missing.select(key, F.coalesce("block_start", F.lit(2147483647)).alias("block_index"), F.lit(1).alias("class"), F.col("ord").alias("outline_ord"), F.lit("heading").alias("node_type"), "level", "title")
    rows = made.unionByName(added)
    w = Window.partitionBy(key).orderBy("block_index", "class", F.coalesce("outline_ord", F.lit(-1)))
    rows = rows.withColumn("sort_order", F.row_number().over(w) - 1)
    rows = rows.withColumn("node_id", F.format_string("t%04d", F.col("sort_order") + 1))
    heading = F.last(F.when(F.col("node_type") == "heading", F.col("node_id")), ignorenulls=True).over(Window.partitionBy(key).orderBy("sort_order").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("text_parent", heading)
    ids = rows.where("outline_ord is not null").select(F.col(key).alias("k3"), F.col("outline_ord").alias("po"), F.col("node_id").alias("heading_parent"))
    up = (outline if "parent_ord" in outline.columns else with_parent(outline, key)).select(F.col(key).alias("k2"), F.col("ord").alias("oo"), "parent_ord")
    rows = rows.join(up, (F.col(key) == F.col("k2")) & (F.col("outline_ord") == F.col("oo")), "left").join(ids, (F.col(key) == F.col("k3")) & (F.col("parent_ord") == F.col("po")), "left")
    parent = F.when(F.col("node_type") == "heading", F.col("heading_parent")).otherwise(F.col("text_parent"))
    return rows.select(key, "sort_order", "node_id", parent.alias("parent_id"), "node_type", "level", "title", F.when(F.col("class") != 1, F.col("block_index")).alias("block_index"), "outline_ord")


def duplicate_anchors(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block_start, n): blocks at which several outline nodes start."""
    return outline.where("block_start is not null").groupBy(key, "block_start").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def linkage(outline: DataFrame, tree_nodes: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, tree_ids, chunk_ids, primary_chunk_id, missing_tree_node) of each outline node.

    ``chunks`` has key, ordinal, chunk_id, heading_level, node_ord; the primary chunk is the first with a heading, else the first.
    """
    listed = lambda what, order: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(what).alias("x")))), lambda s: s["x"])
    t = tree_nodes.where("outline_ord is not null").groupBy(key, F.col("outline_ord").alias("ord")).agg(listed("node_id", "sort_order").alias("tree_ids"))
    c = chunks.groupBy(key, F.col("node_ord").alias("ord")).agg(listed("chunk_id", "ordinal").alias("chunk_ids"), F.min_by("chunk_id", F.struct(F.col("heading_level").isNull(), F.col("ordinal"))).alias("primary_chunk_id"))
    none = F.array().cast("array<string>")
    rows = outline.select(key, "ord").join(t, [key, "ord"], "left").join(c, [key, "ord"], "left")
    return rows.select(key, "ord", F.coalesce("tree_ids", none).alias("tree_ids"), F.coalesce("chunk_ids", none).alias("chunk_ids"), "primary_chunk_id", F.col("tree_ids").isNull().alias("missing_tree_node"))


def chunk_tree_nodes(chunks: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_id, document_tree_node_id): for chunks that begin with a heading, their outline node's first tree node."""
    rows = chunks.where("heading_level is not null").select(key, "chunk_id", F.col("node_ord").alias("ord"))
    return rows.join(links.select(key, "ord", "tree_ids"), [key, "ord"], "left").select(key, "chunk_id", F.try_element_at("tree_ids", F.lit(1)).alias("document_tree_node_id"))


def nested_order(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``depth`` and ``preorder`` to nodes with ``ancestors`` (ords from the root to the node)."""
    rows = nodes.withColumn("depth", F.size("ancestors") - 1)
    return rows.withColumn("preorder", F.row_number().over(Window.partitionBy(key).orderBy(F.transform("ancestors", lambda x: x.cast("long")))) - 1)
