"""Reports as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bullet(title: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) == "", F.concat(F.lit("- **"), title, F.lit("**"))).otherwise(F.concat(F.lit("- **"), title, F.lit("**: "), body))


def report(items: DataFrame, key: str = "doc_id", heading: str = "# Report") -> DataFrame:
    """(key, markdown) of items (key, section_ord, section, ord, title, body): a heading per section, a line per item."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", bullet(F.col("title"), F.col("body")).alias("l")))), lambda x: x["l"])
    parts = items.groupBy(key, "section_ord", "section").agg(F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(lines, "\n")).alias("p"))
    return parts.groupBy(key).agg(F.concat(F.lit(f"{heading}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "p"))), lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("markdown"))


def outline(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, markdown) of nodes (key, preorder, depth, title): a heading each, six levels deep at most."""
    line = F.concat(F.repeat(F.lit("#"), F.least(F.col("depth") + 2, F.lit(6)).cast("int")), F.lit(" "), F.col("title"))
    return nodes.groupBy(key).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", line.alias("l")))), lambda x: x["l"]), "\n\n"), F.lit("\n")).alias("markdown"))


def flat_directory(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds dir_id to nodes (key, preorder, ...), numbered in pre-order."""
    from pyspark.sql import Window

    return nodes.withColumn("dir_id", F.format_string("dir-%03d", F.row_number().over(Window.partitionBy(key).orderBy("preorder"))))
