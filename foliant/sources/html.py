"""Markdown lines from simple web pages, in the JVM: headings, paragraphs, list items; other elements' text stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

# The character references that are decoded here.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&amp;": "&"}


def to_markdown(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav|footer)\b.*?</\1>|<!doctype[^>]*>", "")
    for level in range(1, 7):
        c = F.regexp_replace(c, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|h[1-6]|ul|ol|li|br|article|section|table|tr|body|html)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for name, sign in REFERENCES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def blocks(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_index, block_type, level, text): a row per non-blank line of the page's Markdown."""
    rows = df.select(key, F.posexplode(F.split(to_markdown(F.col(html)), "\n")).alias("n", "line")).withColumn("line", t.normalize_ws(F.col("line"))).where("line <> ''")
    from pyspark.sql import Window

    level = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    kind = F.when(level > 0, F.lit("heading")).when(F.col("line").startswith("- "), F.lit("list_item")).otherwise(F.lit("paragraph"))
    text = F.regexp_replace("line", r"^(#{1,6}|-) ", "")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).alias("block_index"), kind.alias("block_type"), level.alias("level"), text.alias("text"))
